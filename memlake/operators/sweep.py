"""Maintenance of a stored graph: the rules that proposals must meet, applied to what is there."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memlake.functions import names as N
from memlake.operators.graph import visible
from memlake.operators.shared import stored

#: Facts from which a role is a hub, which keeps its node under a qualified name; most characters of a name.
HUB, NAME_CAP = 20, 160
TEXTS = "array<string>"


def no_texts() -> Column:
    return F.array().cast(TEXTS)


def kept_aliases(owners: DataFrame) -> DataFrame:
    """(id, kept): of owners (id, name, aliases) the aliases that are spellings of a name, and not of the owner's own, in order."""
    each = owners.select("id", N.name_key(F.col("name")).alias("own"), F.posexplode("aliases").alias("pos", "alias"))
    each = each.withColumn("key", N.name_key(F.col("alias"))).where(N.alias_shaped(F.col("alias")) & (F.col("key") != F.col("own")))
    return each.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "alias"))), lambda x: x["alias"]).alias("kept"))


def leaf(path: Column) -> Column:
    """The last part of a path, without blanks and marks at its ends."""
    last = F.regexp_extract(F.regexp_replace(path, r"[\\/]+$", ""), r"([^\\/]*)$", 1)
    return F.regexp_replace(last, rf"^[{N.SPACE}.:_-]+|[{N.SPACE}.:_-]+$", "")


def state_lines(facts: DataFrame) -> DataFrame:
    """(node, state): the active facts (node, seq, id, key, value, status) of each node as `key: value` lines, in their order."""
    live = facts.where("status = 'active'").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("seq", "id", F.concat("key", F.lit(": "), "value").alias("line")))).alias("lines"))
    return live.select("node", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("state"))


def tagged(tags: Column, mark: str, when: Column) -> Column:
    return F.when(when & ~F.array_contains(tags, mark), F.array_append(tags, F.lit(mark))).otherwise(tags)


class Swept:
    """nodes (id, name, type, aliases, tags, state, status, family, done), facts and concepts as they were given but for what changed, report (rule, n): each made when it is asked for, see `sweep`."""

    def __init__(self, nodes: DataFrame, facts: DataFrame, concepts: DataFrame, hub: int):
        self._given, self._facts, self._concepts, self._hub = nodes, facts, concepts, hub

    @cached_property
    def _known(self) -> DataFrame:
        """The nodes with what the rules say of their names."""
        live_facts = self._facts.where(F.col("status").isin("active", "disputed")).groupBy(F.col("node").alias("of")).agg(F.count(F.lit(1)).alias("n_facts"))
        known = self._given.join(live_facts, F.col("id") == F.col("of"), "left").drop("of").withColumns({"n_facts": F.coalesce("n_facts", F.lit(0)), "aliases": F.coalesce("aliases", no_texts()), "tags": F.coalesce("tags", no_texts()), "seen": F.col("status").isin("active", "disputed")})
        wanted = N.qualify(F.col("name"), F.col("family"))
        claims = (F.col("n_facts") >= self._hub) & N.qualifier_of(wanted).isNotNull() & (F.length(wanted) <= NAME_CAP)
        known = known.withColumn("role", F.col("seen") & N.bare_role(F.col("name"), F.col("type")))
        known = known.withColumn("wanted", F.when(F.col("role") & claims, wanted))
        known = stored(known.withColumns({"own_key": N.name_key(F.col("name")), "target": N.name_key(F.col("wanted"))}))
        taken = known.where("seen").select(F.col("own_key").alias("target")).distinct()
        place = W.partitionBy("target").orderBy("id")
        won = known.where("target is not null").join(taken, "target", "left_anti").withColumn("k", F.row_number().over(place)).where("k = 1").select(F.col("id").alias("won"))
        done = F.when(F.col("won").isNotNull(), "qualified").when(F.col("target").isNotNull(), "blocked").when(F.col("role"), "archived").otherwise("kept")
        known = known.join(won, F.col("id") == F.col("won"), "left").withColumn("done", done)
        goes = F.col("done").isin("archived", "blocked")
        is_path = F.col("seen") & (F.col("type") == "place") & N.path_like(F.col("name"))
        last = leaf(F.col("name"))
        known = known.withColumn("leaf", F.when(is_path & (last != "") & ~N.path_like(last), F.left(last, F.lit(NAME_CAP))))
        return stored(known.withColumns({"new_name": F.when(F.col("done") == "qualified", F.col("wanted")).otherwise(F.coalesce("leaf", "name")), "stuck": is_path & F.col("leaf").isNull(), "open": F.col("seen") & ~goes}))

    @cached_property
    def _here(self) -> DataFrame:
        return self._concepts.withColumn("aliases", F.coalesce("aliases", no_texts())).withColumn("seen", F.col("status").isin("active", "disputed"))

    @property
    def renamed(self) -> DataFrame:
        """The facts with their new keys (new_key), whether that is another one (renamed) and whether the rules apply to them (open); not stored."""
        owners = self._known.where("open").select(F.col("id").alias("node")).union(self._here.where("seen").select("id"))
        touched = self._facts.join(owners.withColumn("open", F.lit(True)), "node", "left").withColumn("open", F.coalesce("open", F.lit(False)) & ~F.col("status").isin("superseded", "archived"))
        key = F.when(F.col("open"), N.fact_key(F.col("key"))).otherwise(F.col("key"))
        return touched.withColumn("new_key", key).withColumn("renamed", F.col("new_key") != F.col("key"))

    @cached_property
    def _new_facts(self) -> DataFrame:
        return stored(self.renamed)

    @cached_property
    def _rows(self) -> DataFrame:
        known, new_facts = self._known, self._new_facts
        unruled = new_facts.where(F.col("open") & ~N.ruled(F.col("new_key"))).select(F.col("node").alias("id"), F.lit(True).alias("unruled")).distinct()
        states = state_lines(new_facts.withColumn("key", F.col("new_key"))).select(F.col("node").alias("id"), F.col("state").alias("new_state"))
        spelled = kept_aliases(known.where("open").select("id", F.col("new_name").alias("name"), "aliases"))
        rows = known.join(unruled, "id", "left").join(states, "id", "left").join(spelled, "id", "left")
        opened = F.col("open")
        rows = rows.withColumns({"unruled": F.coalesce("unruled", F.lit(False)), "kept": F.when(opened, F.coalesce("kept", no_texts())).otherwise(F.col("aliases")), "new_state": F.when(opened, F.coalesce("new_state", F.lit(""))).otherwise(F.col("state"))})
        return rows.withColumn("new_tags", tagged(tagged(F.col("tags"), N.PATH_TAG, F.col("leaf").isNotNull()), N.UNRULED, opened & F.col("unruled")))

    @cached_property
    def _told(self) -> DataFrame:
        spelled = kept_aliases(self._here.where("seen"))
        return self._here.join(spelled, "id", "left").withColumn("kept", F.when(F.col("seen"), F.coalesce("kept", no_texts())).otherwise(F.col("aliases")))

    @property
    def nodes(self) -> DataFrame:
        status = F.when(F.col("done").isin("archived", "blocked"), "archived").otherwise(F.col("status"))
        return self._rows.select("id", F.col("new_name").alias("name"), "type", F.col("kept").alias("aliases"), F.col("new_tags").alias("tags"), F.col("new_state").alias("state"), status.alias("status"), "family", "done")

    @property
    def facts(self) -> DataFrame:
        return self._new_facts.select("id", "node", "seq", F.col("new_key").alias("key"), "value", "status")

    @property
    def concepts(self) -> DataFrame:
        return self._told.select("id", "name", "category", F.col("kept").alias("aliases"), "status")

    @property
    def report(self) -> DataFrame:
        n = lambda c: F.count_if(c)
        pruned = F.size("aliases") - F.size("kept")
        gone = F.col("done").isin("archived", "blocked")
        of_nodes = {
            "scanned": n(F.col("seen")), "role_archived": n(gone), "role_qualified": n(F.col("done") == "qualified"), "role_blocked": n(F.col("done") == "blocked"), "place_renamed": n(F.col("leaf").isNotNull()), "place_stuck": n(F.col("stuck")),
            "aliases_pruned": F.coalesce(F.sum(pruned), F.lit(0)), "states_rebuilt": n(F.col("open") & (F.coalesce("state", F.lit("")) != F.col("new_state"))), "nodes_unruled": n(F.col("open") & F.array_contains("new_tags", N.UNRULED)),
            "archived_facts": F.coalesce(F.sum(F.when(gone, F.col("n_facts"))), F.lit(0)), "archived_most_facts": F.coalesce(F.max(F.when(gone, F.col("n_facts"))), F.lit(0)),
        }
        same = self._here.where("seen").select(N.name_key(F.col("name")).alias("key"), "category").groupBy("key", "category").agg((F.count(F.lit(1)) - 1).alias("more"))
        sums: list[tuple[DataFrame, dict[str, Column]]] = [(self._rows, of_nodes), (self._new_facts, {"facts_renamed": n(F.col("renamed"))}), (self._told, {"concept_aliases_pruned": F.coalesce(F.sum(pruned), F.lit(0))}), (same, {"concept_duplicates": F.coalesce(F.sum("more"), F.lit(0))})]
        each = [df.agg(*(c.cast("long").alias(name) for name, c in columns.items())).select(F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), F.col(name).alias("n")) for name in columns))).alias("x")).select("x.*") for df, columns in sums]
        return reduce(DataFrame.union, each)


def sweep(nodes: DataFrame, facts: DataFrame, concepts: DataFrame, hub: int = HUB) -> Swept:
    """The graph with its rules applied: nodes (id, name, type, aliases, tags, state, status, family), facts (id, node, seq, key, value, status), concepts (id, name, category, aliases, status).

    Only active and disputed nodes and concepts are touched. A person or organisation named by a bare role is archived; one with `hub` live facts is
    named `name@family` instead, if no visible node has that name. Of several that want one name the least id gets it and the others are archived, so the
    order of rows doesn't matter. Places that are paths take their last part, if that is no path, and a mark. Aliases that are no spellings go; live facts get
    canonical keys, nodes with other keys a mark, and states are written anew from active facts. Concepts that share name and category are reported, not
    merged. `done` says kept, archived (blocked, if a name was taken) or qualified. A second sweep changes nothing. Null lists count as empty.
    """
    return Swept(nodes, facts, concepts, hub)


def concept_classes(concepts: DataFrame) -> DataFrame:
    """(id, kept): which visible concept (id, name, category, status) stands for each, if those that share name and category are merged: the least id."""
    keyed = visible(concepts).select("id", "category", N.name_key(F.col("name")).alias("key"))
    first = keyed.groupBy("key", "category").agg(F.min("id").alias("kept"))
    return keyed.join(first, ["key", "category"]).select("id", "kept")
