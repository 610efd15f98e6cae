"""What names look like, by given cases and by plain loops."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from memlake.functions import columns as C
from memlake.functions import names as N
from memlake.operators import analytics, graph

PATHS = ["E:\\test\\machine-learning\\.venv", ".agents/skills", "C:\\Users\\someone\\.acme", "dist/", "$env:TEMP", "~/memory.db", "src/graph/apply.ts", "/c/x/y", "../x", "${HOME}", " a.JSON ", "one/two/three"]
NO_PATHS = ["@scope/pkg-name", "https://github.com/someone", "HTTP://x.y/", "VSCode", "a/b", "/x", "", "//server/share", "a/"]
ROLES = [
    "用户", "助手", "AI", "AI/Agent", "AI代理", "AI执行代理", "全栈开发者", "插件维护者", "插件开发者", "开发团队", "项目主导者", "项目维护者", "dev maintainer", "数据维护方", "执行分析的助手", "Assistant",
    "chief steward", "当前执行会话", "用户/AI协作", "用户沟通偏好与背景", "自动化Agent", "AI/维护者", "团队", "插件开发团队", "维护者",
]
NO_ROLES = ["用户@ACME", "张三", "GraphX", "团队A", "产品B3", "王小明", "", "the user", "maintainers of it all"]
DESCRIPTIVE = ["Widgetry 排 #12", "确认了方案", "x" * 41, "ExampleAI下降49,397", "3倍 降"]
CATEGORIES = {
    "压缩算法": "algorithm", "S1搜索重排机制": "mechanism", "NPM 发布操作规范": "spec", "第一性原理": "principle", "单写多读架构": "pattern", "ACME 框架": "other", "B+树索引": "algorithm", "RRF 倒数排名融合": "algorithm",
    "蒸馏管线": "mechanism", "插件发布门禁": "spec", "缓存一致性原则": "principle", "观察者模式": "pattern", "ＰＩＰＥＬＩＮＥ": "mechanism",
}
BLANK = "[ \t\n\x0b\f\r\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def told(spark, names, **columns):
    rows = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k long, name string").select("k", *(c(F.col("name")).alias(n) for n, c in columns.items())).collect()
    return {names[r["k"]]: tuple(r)[1:] if len(columns) > 1 else r[1] for r in rows}


def test_shapes(spark):
    kinds = told(spark, PATHS + NO_PATHS, path=N.path_like)
    assert [n for n in PATHS if not kinds[n]] == [] and [n for n in NO_PATHS if kinds[n]] == []
    roles = told(spark, ROLES + NO_ROLES, role=N.role_like)
    assert [n for n in ROLES if not roles[n]] == [] and [n for n in NO_ROLES if roles[n]] == []
    kind = told(spark, [*ROLES, *PATHS, *DESCRIPTIVE, "老张", "Mary Major"], kind=N.name_kind)
    assert all(kind[n] == "role" for n in ROLES) and all(kind[n] == "path" for n in PATHS) and all(kind[n] == "descriptive" for n in DESCRIPTIVE)
    assert kind["老张"] == kind["Mary Major"] == "proper"
    alias = told(spark, ["老张", "Mary Major", "Widgetry 排 #12", "用户确认口径后执行", "C:\\x\\y", "", "　"], alias=N.alias_shaped)
    assert [n for n, ok in alias.items() if ok] == ["老张", "Mary Major"]
    assert told(spark, list(CATEGORIES), category=N.concept_category) == CATEGORIES
    stated = spark.createDataFrame([(" Spec ", "压缩算法"), ("nonsense", "压缩算法"), (None, "什么")], "c string, n string")
    assert [r[0] for r in stated.select(N.concept_category(F.col("n"), F.col("c"))).collect()] == ["spec", "algorithm", "other"]


def test_qualifiers(spark):
    cases = {"用户@ACME": ("用户", "ACME"), "王小明": ("王小明", None), "@someone": ("@someone", None), "a@b@c": ("a@b", "c"), "名字@": ("名字", None), " x @　y ": ("x", "y"), "@a@b": ("@a", "b"), "": ("", None)}
    assert told(spark, list(cases), base=N.base_of, q=N.qualifier_of) == cases
    pairs = spark.createDataFrame([("用户", "ACME"), ("用户", None), (" 用户 ", "　")], "b string, q string")
    assert [r[0] for r in pairs.select(N.qualify(F.col("b"), F.col("q"))).collect()] == ["用户@ACME", "用户", "用户"]


def test_keys_by_plain_loops(spark):
    draw = random.Random(6)
    parts = ["AI", "ai", "Ａ", "ｉ", "-", "_", " ", "　", "\xa0", "\u2003", "é", "É", "ﬁ", "ｶﾞ", "张", "\ufeff", "\t", "\x0b", "(", "“", "】", "'"]
    names = list({"".join(draw.choice(parts) for _ in range(draw.randrange(0, 6))) for _ in range(400)})
    key = lambda n: re.sub(f"(?:{BLANK}|[_-])+", "", unicodedata.normalize("NFKC", n).lower()) or n
    assert told(spark, names, key=N.name_key) == {n: key(n) for n in names}
    claim = lambda n: re.sub(f"(?:{BLANK}|[\"'`“”‘’()（）\\[\\]【】])+", "", n.lower())
    assert told(spark, names, key=N.claim_key) == {n: claim(n) for n in names}
    fold = lambda n: re.sub(f"{BLANK}+", " ", n).strip(" ")
    assert told(spark, names, key=C.squeezed) == {n: fold(n) for n in names}


def test_qualifiers_keep_entities_apart(spark):
    """Spellings join, over chains too; two qualifiers never do, though a third name links them."""
    rows = [
        ("1", "tool", "AI-agent", True), ("2", "tool", "aiagent", True), ("3", "tool", "ＡＩ　Ａｇｅｎｔ", True), ("4", "person", "ai agent", True),
        ("5", "person", "用户@ACME", True), ("6", "person", "用户@acme", True), ("7", "person", "用户@GitHub", True), ("8", "person", "用户", True),
        ("5", "person", "老用户@ACME", False), ("9", "person", "老用户@acme", True), ("7", "person", "共同", False), ("5", "person", "共同", False), ("10", "person", "共同", True), ("7", "person", "老用户@ACME", False),
        ("11", "tool", " ", True), ("12", "tool", "--", True), ("13", "tool", "--", True), ("14", "tool", "__", True),
    ]
    got = {r["id"]: r["entity"] for r in graph.resolve_entities(spark.createDataFrame(rows, "id string, type string, name string, own boolean").repartition(3)).collect()}
    assert got == {"1": "1", "2": "1", "3": "1", "4": "4", "5": "5", "6": "5", "9": "5", "7": "7", "8": "8", "10": "10", "12": "12", "13": "12", "14": "14"}


def test_claims_are_compared_by_keys(spark):
    rows = [
        ("Ａ", "size", None, "5 GB", 1), ("Ａ", "Size ", None, "5gb", 1), ("b", "x", None, "“1”", None), ("b", "(x)", "", "2", None), ("c", "x", "eu", "1", 1), ("C", "x", "us", "2", 2), ("c", "y", None, "1", 1), ("c", "y", None, "2", 2),
        ("", "x", None, "1", 1), (None, "x", None, "2", 1), (" ", "x", None, "3", 1), ("d", "z", "EU", "1", 1), ("d", "z", "e u", "2", 2), ("d", "z", "eu", None, 3),
    ]
    got = {(r["entity"], r["attribute"]): (r["n"], r["values"], r["verdict"]) for r in analytics.claim_classes(spark.createDataFrame(rows, "entity string, attribute string, scope string, value string, time_ms long")).collect()}
    assert got == {("ａ", "size"): (2, 1, "agreement"), ("b", "x"): (2, 2, "hard"), ("c", "x"): (2, 2, "conditional"), ("c", "y"): (2, 2, "supersession"), ("d", "z"): (3, 3, "supersession")}
