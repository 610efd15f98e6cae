"""Record semantics as column expressions: everything here stays in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from memlake.functions.names import SPACE

# Types and their families, and the five-way hall of a type.
CHAT_TYPES = ("persona", "episodic", "instruction", "user_info", "user_hobby", "user_communication", "user_behavior", "unclassified")
WORK_TYPES = (
    "work_fact", "work_task", "work_method", "work_artifact", "project_introduction", "project_tech_stack", "project_architecture", "project_build_configuration",
    "project_dependency_configuration", "project_ide_configuration", "project_scm_configuration", "project_environment_configuration", "project_rule",
    "development_code_specification", "development_practice_specification", "development_test_specification", "development_comment_specification",
    "task_summary_experience", "task_breakdown_experience", "task_flow_experience", "task_experience", "tool_experience", "mcp_experience", "skill_experience",
    "learned_skill_experience", "expert_experience", "important_decision_experience", "common_pitfalls_experience", "history_task_reference_files", "external_fact",
)
HALLS = {"work_fact": "facts", "work_artifact": "facts", "persona": "facts", "episodic": "events", "work_task": "events", "work_method": "discoveries", "instruction": "preferences"}
WINGS = ("work", "relationships", "learning", "creative", "home", "health", "finance", "journey")
FALLBACK_WING = "general"


def text_map(pairs: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def null_if_blank(c: Column) -> Column:
    return F.when(c != "", c)


def norm_scope(scope: Column) -> Column:
    return F.when(F.lower(scope) == "workspace", "workspace").otherwise("global")


def scope_visible(scope: Column, workspace_id: Column, want: Column) -> Column:
    """Global is visible everywhere, a workspace's only there; an empty or null want sees global rows alone."""
    same = F.coalesce((workspace_id != "") & (workspace_id == want), F.lit(False))
    return (norm_scope(scope) == "global") | same


def resolve_scope(mode: Column, family: Column, workspace_id: Column, explicit: Column) -> Column:
    """struct(scope, workspace_id): stated, else by mode and family; global if there's no workspace."""
    wanted = F.coalesce(explicit, F.when((mode == "workspace") & (family == "work"), "workspace").otherwise("global"))
    local = (wanted == "workspace") & F.coalesce(workspace_id != "", F.lit(False))
    return F.struct(F.when(local, "workspace").otherwise("global").alias("scope"), F.when(local, workspace_id).alias("workspace_id"))


def resolve_family(forced: Column, extracted: Column, kind: Column) -> Column:
    by_type = F.when(kind.isin(*CHAT_TYPES), "chat").when(kind.isin(*WORK_TYPES), "work")
    by_prefix = F.when(kind.startswith("work"), "work").otherwise("chat")
    return F.coalesce(forced, F.when(extracted.isin("chat", "work"), extracted), by_type, by_prefix)


def cognitive_hall(kind: Column) -> Column:
    return text_map(HALLS)[kind]


def is_retired(reason: Column) -> Column:
    return reason.isNotNull()


def validity_state(reason: Column, persistence: Column, valid_to: Column, source: Column, now: Column) -> Column:
    """Six states: a marker comes first, then the time axis by persistence."""
    past = F.coalesce((valid_to > 0) & (valid_to <= now), F.lit(False))
    return (
        F.when(reason.isin("manual", "obsolete"), "retired")
        .when(reason.isNotNull(), "superseded")
        .when(persistence.isNull(), F.when(past, "expired_suspect").otherwise("current"))
        .when(persistence == "o", F.when(~past, "current").when(source == "evidence", "expired").otherwise("expired_suspect"))
        .otherwise("historical")
    )


def as_of(reason: Column, created: Column, valid_from: Column, valid_to: Column, at: Column) -> Column:
    """Valid at a time; never what has been retired."""
    return reason.isNull() & (F.coalesce(valid_from, created) <= at) & (valid_to.isNull() | (at < valid_to))


def fence_weight(family: Column, repo: Column, applicability: Column, current: Column, multiplier: float) -> Column:
    """Below 1 only for work rows of another repository that don't say they cross projects."""
    factor = multiplier if 0 < multiplier <= 1 else 0.2
    other = (family == "work") & (repo != "") & (repo != current) & ~F.coalesce(applicability == "cross-project", F.lit(False))
    return F.when(F.coalesce(other, F.lit(False)), F.lit(factor)).otherwise(F.lit(1.0))


def decay_weight(updated: Column, now: Column, half_life_days: float, floor: float = 0.5) -> Column:
    days = F.greatest(F.lit(0.0), (now - updated) / 86_400_000.0)
    return F.when(updated.isNull(), F.lit(floor)).otherwise(F.greatest(F.lit(floor), F.pow(F.lit(0.5), days / half_life_days)))


def mark_signal(mark: Column) -> Column:
    return F.when(mark == 5, 1.0).when(mark == 4, 0.5).when(mark == 2, -0.4).when(mark == 1, -0.7).when(mark == 0, -1.0).otherwise(0.0)


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def maturity(priority: Column, used: Column, aging: Column, mark: Column) -> Column:
    """struct(score, level)"""
    score = clamp(0.45 * clamp(priority / 100) + 0.3 * clamp(F.coalesce(used, F.lit(0)) / 5) + 0.25 * F.coalesce(clamp(aging), F.lit(1.0)) + 0.3 * mark_signal(mark))
    return F.struct(score.alias("score"), F.when(score >= 0.66, "high").when(score >= 0.4, "mid").otherwise("low").alias("level"))


def rank_score(rank: Column) -> Column:
    """A full-text rank (below zero is better) to (0, 1)."""
    return F.when(rank.isNull(), 1 / 1000).when(rank < 0, -rank / (1 - rank)).otherwise(1 / (1 + rank))


def rrf_term(rank0: Column, k: int = 60) -> Column:
    return 1.0 / (k + rank0 + 1)


def squeezed(text: Column) -> Column:
    """Each run of white space, that beyond ASCII too, as one space; none at the ends."""
    return F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def content_key(text: Column) -> Column:
    return F.lower(squeezed(text))


def content_digest(text: Column) -> Column:
    return F.sha2(content_key(text), 256)


def input_digest(ids: Column, version: str = "inputs/v1") -> Column:
    """Digest of an ordered list, injective by length prefixes."""
    parts = F.transform(ids, lambda x: F.concat(F.length(x).cast("string"), F.lit(":"), x, F.lit("\n")))
    return F.sha2(F.concat(F.lit(version + "\n"), F.array_join(parts, "")), 256)


TAG = r"[a-z0-9][a-z0-9-]{0,31}"


def norm_tags(tags: Column, most: int = 3) -> Column:
    cleaned = F.transform(tags, lambda t: F.lower(F.trim(t)))
    return F.slice(F.array_distinct(F.filter(cleaned, lambda t: t.rlike(rf"^{TAG}(/{TAG})?$"))), 1, most)


def norm_phrases(phrases: Column, chars: int = 60, most: int = 3) -> Column:
    cleaned = F.filter(F.transform(phrases, lambda p: F.trim(p)), lambda p: p != "")
    return F.transform(F.slice(F.array_distinct(cleaned), 1, most), lambda p: F.substring(p, 1, chars))


def norm_keywords(words: Column, chars: int = 24, most: int = 5) -> Column:
    """The first of each spelling that differs in case only."""
    cleaned = F.filter(F.transform(words, lambda w: F.trim(w)), lambda w: w != "")
    seen = F.transform(cleaned, F.lower)
    placed = F.transform(cleaned, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    firsts = F.filter(placed, lambda x: F.array_position(seen, F.lower(x["w"])) == x["i"] + 1)
    return F.transform(F.slice(firsts, 1, most), lambda x: F.substring(x["w"], 1, chars))


CJK = r"㐀-鿿豈-﫿"


def tokens(text: Column) -> Column:
    """Different tokens of a text: Latin words of two or more characters, and pairs of CJK characters (alone where isolated)."""
    low = F.lower(text)
    words = F.regexp_extract_all(low, F.lit(r"[a-z0-9][a-z0-9_-]+"), F.lit(0))
    runs = F.regexp_extract_all(low, F.lit(rf"[{CJK}]+"), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r)), lambda i: F.substring(r, i, F.lit(2)))))
    return F.array_distinct(F.concat(words, pairs))


def grams(text: Column, n: int) -> Column:
    """Different runs of n characters; a text of at most n is one, an empty one has none."""

    def of(t: Column) -> Column:
        slid = F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substring(t, i, F.lit(n)))
        return F.when(F.length(t) == 0, F.array().cast("array<string>")).when(F.length(t) <= n, F.array(t)).otherwise(F.array_distinct(slid))

    # a list of one text binds it: an expression inside the inner function would be evaluated for every run
    return F.element_at(F.transform(F.array(F.lower(squeezed(text))), of), 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null for vectors that can't be compared."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size)


# What hosts put into messages, and what is left in its place; fenced code; phrases of messages that say nothing.
INJECTED = (
    (r"(?s)<(relevant-memories|user-persona|relevant-scenes|scene-navigation|memory-tools-guide|current_task_context)>.*?</\1>", ""),
    (r"(?s)<history_task_context.*?</history_task_context>", ""),
    (r"(?s)(?:Conversation info|Sender|Thread starter|Replied message|Forwarded message context|Chat history since last reply)\s*\(untrusted.*?\):\s*```json\s*.*?```", ""),
    (r"(?s)```json\s*\{.*?\"session.*?\}\s*```", ""),
    (r"\[\[reply_to[^\]]*\]\]\s*", ""),
    (r"(?s)¥¥\[.*?\]¥¥", ""),
    (r"(?m)^\[[\w\d\-:+ ]+\]\s*", ""),
    (r"\[media attached:[^\]]*\]\s*", ""),
    (r"(?s)To send an image back,.*?(?:Keep caption in the text body\.)\s*", ""),
    (r"(?m)^System:\s*\[[\s\S]*?$", ""),
    (r"(?i)data:image/[a-z+]+;base64,[A-Za-z0-9+/=]+", ""),
    (r"\x00", ""),
    (r"\n{3,}", "\n\n"),
)
FENCED = ((r"(?s)```[^\n]*\n.*?```", ""), (r"\n{3,}", "\n\n"))
NOISE = (r"^\(session bootstrap\)$", r"^A new session was started via", r"^✅\s*New session started", r"^Pre-compaction memory flush", r"^NO_REPLY\s*$")


#: What is cut from both ends of a message.
SPACES = " \t\n\x0b\x0c\r\xa0\ufeff\u2028\u2029\u3000"


def _cut(text: Column, rules: tuple) -> Column:
    return F.btrim(reduce(lambda c, rule: F.regexp_replace(c, *rule), rules, text), F.lit(SPACES))


def sanitized(text: Column) -> Column:
    """A message without injected context, metadata, attachments and host directives; blank lines folded."""
    return _cut(text, INJECTED)


def without_code(text: Column) -> Column:
    """An answer without its fenced code."""
    return _cut(text, FENCED)


def capturable(text: Column) -> Column:
    t = F.btrim(text, F.lit(SPACES))
    noise = reduce(lambda x, y: x | y, (t.rlike(pattern) for pattern in NOISE))
    return F.coalesce((t != "") & ~noise & ~text.startswith("/"), F.lit(False))
