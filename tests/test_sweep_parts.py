"""A sweep makes only what is asked for."""

from memlake.operators import sweep as S
from memlake.plans import projection


def test_keys_of_facts_need_no_states_aliases_or_concepts(spark):
    swept = projection.swept(spark, "/root/testdata/sf0.001")
    assert isinstance(swept, S.Swept) and not {"_known", "_rows", "_told", "_new_facts"} & set(vars(swept))
    assert swept.renamed.where("renamed").count() == swept.renamed.where("key <> new_key").count() > 0
    assert "_known" in vars(swept) and not {"_rows", "_told", "_new_facts"} & set(vars(swept))
