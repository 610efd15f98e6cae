"""Names of entities: keys, qualifiers, and what a name looks like, as column expressions.

All of it stays in the JVM but the compatibility form (NFKC) of names with characters beyond ASCII, which takes Arrow batches.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# White space as pattern class; words for roles; endings and shapes of paths; words of phrases that describe; words of the categories of concepts.
SPACE = r" \t\n\x0B\f\r\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
SPACES = " \t\n\x0b\f\r\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"  # the same, one by one
ROLE_WORDS = (
    "用户", "客户", "对方", "本人", "助手", "助理", "代理", "智能体", "机器人", "AI", "Agent", "LLM", "大模型", "模型", "开发团队", "团队", "维护者", "开发者", "工程师", "测试", "产品", "项目经理", "负责人", "执行人",
    "主导者", "维护方", "当前会话", "当前执行会话", "会话", "全栈开发者", "插件维护者", "assistant", "maintainer", "steward", "dev maintainer", "chief steward",
)
NO_PATHS = (r"^@[\w.-]+/[\w.-]+$", r"^(?i:https?)://")
PATHS = (
    r"^[A-Za-z]:[\\/]", r"^~[\\/]", r"^\$\{?[A-Za-z_]", r"^[\\/][^\\/]+[\\/]", r"^\.{1,2}/.+", r"^\.[\w-]+/[^/]+",
    r"\.(?i:md|json|ya?ml|ts|tsx|js|jsx|py|sh|ps1|db|tgz|zip|png|svg|lock|log|txt|toml|ini|env|sql|exe|dll|node)$", r"^[\w.@-]+([\\/][\w.@-]+){2,}$", r"^.{2,}/$",
)
DESCRIBING = (r"确认|执行|发起|审批|核准|驳回|降至|升高|下降|导致|修复了|完成了|将由|需要|应该|禁止", r"#[\d,]+|排\s*#?\d|下降|上升|增长|减少")
MEASURE, MOVES = r"^\d|\d+(%|倍|个|条|次|行|ms|s|天)", r"[排降至升]|#\d"
LONGEST_NAME, LONGEST_REST = 40, 8
CATEGORIES = (
    ("principle", "第一性|定律|定理|悖论|假说|原则"),
    ("algorithm", "算法|compression|压缩|编码|分词|tokenizer|索引|融合|加密|哈希|排名|检索"),
    ("mechanism", "机制|原理|管线|pipeline|流程|回路|链路|通道"),
    ("spec", "规范|标准|约定|门禁|口径|守则|纪律|checklist|清单"),
    ("pattern", "模式|范式|pattern|架构|风格|模板"),
)
CATEGORY_NAMES = ("algorithm", "mechanism", "spec", "principle", "pattern", "other")
# The keys that facts should have, other ways to say them, and the marks of nodes.
FACT_KEYS = (
    "状态", "定义", "用途", "适用范围", "失效条件", "生效条件", "触发条件", "风险", "版本", "负责人", "成员", "角色", "职责", "职业", "雇主", "所在地", "时间", "原因", "结果", "依据", "结论", "目标", "下一步", "进度", "里程碑",
    "交付物", "问题", "方案", "步骤", "命令", "配置", "路径", "端口", "地址", "域名", "链接", "成本", "性能", "规模", "数量", "依赖", "替代", "竞争", "评价", "偏好", "约定",
)
FACT_SYNONYMS = {
    "当前状态": "状态", "本批状态": "状态", "运行状态": "状态", "项目状态": "状态", "进展": "进度", "用途定位": "用途", "定位": "用途", "作用": "用途", "功能": "用途", "适用场景": "适用范围", "适用条件": "适用范围", "边界": "适用范围",
    "触发时机": "触发条件", "前提": "生效条件", "失效场景": "失效条件", "负责人角色": "角色", "协作角色": "角色", "会话角色": "角色", "来源角色": "角色", "职业背景": "职业", "岗位方向": "职业", "职位": "职业",
    "核心职责": "职责", "研究职责": "职责", "任务职责": "职责",
}
STATE_KEY, UNRULED, PATH_TAG = "状态", "未规范", "路径"
NODE_TYPES = ("person", "project", "organization", "tool", "place", "activity")
BRACKETS = r"""[ \t\n\x0B\f\r\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"'`“”‘’()（）\[\]【】]+"""


@F.arrow_udf(StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


def compatible(text: Column) -> Column:
    """The text in compatibility form (NFKC). Texts of ASCII alone are that already; only others go to Python."""
    wide = text.rlike(r"[^\x00-\x7F]")
    return F.when(wide, _nfkc(F.when(wide, text))).otherwise(text)


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def name_key(name: Column) -> Column:
    """What spellings of a name have in common: NFKC, lower case, without white space, _ and -; the name as it is where nothing is left."""
    key = F.regexp_replace(F.lower(compatible(name)), f"[{SPACE}_-]+", "")
    return F.when(key == "", name).otherwise(key)


def claim_key(text: Column) -> Column:
    """What spellings of a claim's part have in common: lower case, without white space, quotes and brackets; a null is empty."""
    return F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), BRACKETS, "")


def base_of(name: Column) -> Column:
    """The name before its last @, where something is before it; `@name` is a name."""
    n = trimmed(name)
    return F.when(n.rlike(r"(?s)^.+@[^@]*$"), trimmed(F.regexp_replace(n, r"(?s)@[^@]*$", ""))).otherwise(n)


def qualifier_of(name: Column) -> Column:
    """What is behind the last @ of a name, or null."""
    behind = trimmed(F.regexp_extract(trimmed(name), r"(?s)^.+@([^@]*)$", 1))
    return F.when(behind != "", behind)


def qualifier_key(name: Column) -> Column:
    return F.coalesce(name_key(qualifier_of(name)), F.lit(""))


def qualify(base: Column, qualifier: Column) -> Column:
    q = F.coalesce(trimmed(qualifier), F.lit(""))
    return F.when(q == "", trimmed(base)).otherwise(F.concat(trimmed(base), F.lit("@"), q))


def any_of(text: Column, patterns: tuple[str, ...]) -> Column:
    return text.rlike("|".join(f"(?:{p})" for p in patterns))  # one pattern: the text is worked out once


def path_like(name: Column) -> Column:
    """Drives, home folders, variables, several levels, common endings of files; not packages of a scope (`@a/b`), nor web addresses."""
    n = trimmed(name)
    return ~any_of(n, NO_PATHS) & any_of(n, PATHS)


def role_like(name: Column) -> Column:
    """A name without @ that is a word for a role, or begins or ends with one, the rest being short and about a role too.

    The words are gone through only for names that are short enough and have one of them at an end; the others cost one pattern.
    """
    low = F.lower(trimmed(name))
    words = F.array(*(F.lit(w.lower()) for w in ROLE_WORDS))
    one = "|".join(re.escape(w.lower()) for w in ROLE_WORDS)

    def about_a_role(rest: Column) -> Column:
        return F.element_at(F.transform(F.array(F.regexp_replace(rest, r"[^\p{L}\p{N}]", "")), lambda bare: F.exists(words, lambda w: F.contains(bare, w)) | ~bare.rlike("[a-z0-9]")), 1)

    def any_word(n: Column) -> Column:
        def at_an_end(w: Column) -> Column:
            rest = F.length(n) - F.length(w)
            tail, head = F.substring(n, F.length(w) + 1, rest), F.substring(n, F.lit(1), rest)
            return (rest >= 0) & (rest <= LONGEST_REST) & ((F.startswith(n, w) & about_a_role(tail)) | (F.endswith(n, w) & about_a_role(head)))

        return F.exists(words, at_an_end)

    # a list of one text binds it: an expression inside the inner functions would be evaluated for every word
    looked_up = F.element_at(F.transform(F.array(low), any_word), 1)
    near = low.rlike(rf"(?s)\A(?=.{{1,{max(map(len, ROLE_WORDS)) + LONGEST_REST}}}\z)(?:(?:{one})|.*(?:{one})\z)") & ~F.contains(low, F.lit("@"))
    return F.when(~near, False).otherwise(looked_up)


def descriptive(name: Column) -> Column:
    """A sentence, a reading or something too long, not a name."""
    n = trimmed(name)
    return (F.length(n) > LONGEST_NAME) | any_of(n, DESCRIBING) | (n.rlike(MEASURE) & n.rlike(MOVES))


def name_kind(name: Column) -> Column:
    return F.when(path_like(name), "path").when(role_like(name), "role").when(descriptive(name), "descriptive").otherwise("proper")


def alias_shaped(alias: Column) -> Column:
    return (trimmed(alias) != "") & ~path_like(alias) & ~descriptive(alias)


def concept_category(name: Column, stated: Column | None = None) -> Column:
    """The stated category if it is one, else that of the first group with a word in the name, else other."""
    n = F.lower(compatible(name))
    guessed = reduce(lambda c, g: c.when(n.rlike(g[1]), g[0]), CATEGORIES[1:], F.when(n.rlike(CATEGORIES[0][1]), CATEGORIES[0][0])).otherwise("other")
    if stated is None:
        return guessed
    v = F.lower(trimmed(stated))
    return F.when(v.isin(*CATEGORY_NAMES), v).otherwise(guessed)


def fact_key(key: Column) -> Column:
    """The canonical key of a fact; one that isn't known stays as it is."""
    k = trimmed(key)
    return F.coalesce(F.create_map(*(F.lit(x) for pair in FACT_SYNONYMS.items() for x in pair))[k], k)


def ruled(key: Column) -> Column:
    """Whether a canonical key is one of those that facts should have."""
    return key.isin(*FACT_KEYS, UNRULED)


def ruled_as_given(key: Column) -> Column:
    """Whether a key, as it is, is one of those or a synonym of one. Others may still be, once they are made canonical, which costs more than this."""
    return key.isin(*FACT_KEYS, UNRULED, *(k for k, v in FACT_SYNONYMS.items() if v in FACT_KEYS))


def bare_role(name: Column, type_: Column) -> Column:
    """A person or an organisation that is named by a role alone, without a qualifier."""
    return type_.isin("person", "organization") & qualifier_of(name).isNull() & role_like(name)
