"""Text functions, as Column expressions unless the input is a single query."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Function words and light or vague words ignored in matching.
STOPWORDS = """the a an is are was were did does do what when where who why how would will have has had been be to of in
on at for with from and or but it its her his she he they them their there here that this these those i you we me us my your our""".split()
LIGHT_WORDS = """make makes made does doing take takes took give gives gave come comes came gets getting want wants would could
should shall must like likes liked know knows knew think thinks thought feel feels felt seem seems seemed look looks looked together
really much many something anything someone anyone thing things""".split()
NEGATIONS = "not no never none without cannot cant dont doesnt didnt non nor neither".split()
LIGHT_VERBS = "is was are were be been being am has have had do does did the a an of to".split()
CJK_NEGATION = "不没无未非别莫"
LIST_TOKENS = ("all the", "kinds of", "types of", "things", "items", "do to", "like to")
STATE_PREFIXES = ("goal_", "todo_", "schedule_", "plan_")
# Placeholders that stand for an empty field.
PLACEHOLDERS = "_ PREDICATE OBJECT TIME_EXPR NORMALIZED_FACT UNKNOWN CANONICAL_NAME CANONICAL ENTITY ENTITY_TYPE ALIASES TURN".split()
# Shapes of names that are literals, first match wins.
LITERAL_KINDS = (
    ("number", r"^\d+(?:[.,:]\d+)*$"),
    ("version", r"^v?\d+\.\d+(?:[.\-+][A-Za-z0-9]+)*$"),
    ("quantity", r"(?i)^\d+(?:\.\d+)?\s*(?:k|m|g|s|ms|min|h|%|x|次|个|秒|分钟|小时)?$"),
    ("boolean", r"(?i)^(?:true|false|null|none|nil|yes|no|n/a|undefined)$"),
    ("camelCase", r"^[a-z][a-z0-9]*[A-Z][A-Za-z0-9]*$"),
    ("SCREAMING_SNAKE", r"^[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+$"),
    ("filename", r"(?i)\.(?:ts|tsx|js|mjs|cjs|json|jsonl|md|yaml|yml|py|sh|txt|html|css)$"),
    ("path", r"^(?:~|/|\./|\.\./)"),
)
# Secrets and what replaces them, applied in turn.
SECRETS = (
    (r"(?i)\b(Bearer|Basic|QQBot|Bot)\s+[A-Za-z0-9._~+/=-]{6,}", "$1 ***"),
    (r"\b(sk|rk|pk|ghp|gho|ghs|ghr|github_pat|xox[a-z]|AKIA|ASIA|AIza|hf)[-_][A-Za-z0-9_-]{6,}", "***"),
    (r"\beyJ[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{4,}", "***"),
    (
        r"(?i)\b(api[_-]?key|access[_-]?token|auth[_-]?token|refresh[_-]?token|client[_-]?secret|app[_-]?secret|authorization|password|passwd|secret|token|key)"
        r"(\s*[\"']?\s*[=:]\s*[\"']?)([A-Za-z0-9._~+/=-]{6,})",
        "$1$2***",
    ),
    (r"\b[A-Za-z0-9+/=_-]{32,}\b", "***"),
)


def array_of(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def norm_name(c: Column) -> Column:
    """Trimmed, white space collapsed (Unicode), lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), r"^ | $", ""))


def cache_key(c: Column) -> Column:
    """Lower case, white space collapsed, not trimmed."""
    return F.regexp_replace(F.lower(c), r"(?U)\s+", " ")


def words_of(c: Column) -> Column:
    """Latin runs, then CJK runs: one character as itself, longer ones whole and as bigrams."""
    low = F.lower(c)
    runs = F.regexp_extract_all(low, F.lit("[一-鿿]+"), F.lit(0))

    def grams(run: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2)))
        return F.when(F.length(run) == 1, F.array(run)).otherwise(F.concat(F.array(run), pairs))

    return F.concat(F.regexp_extract_all(low, F.lit("[a-z]+"), F.lit(0)), F.flatten(F.transform(runs, grams)))


def stem(w: Column) -> Column:
    n = F.length(w)

    def cut(k: int) -> Column:
        return F.substring(w, F.lit(1), n - k)

    one = (
        F.when(w.endswith("ies") & (n > 4), F.concat(cut(3), F.lit("y")))
        .when(w.endswith("ing") & (n > 5), cut(3))
        .when(w.endswith("ed") & (n > 4), cut(2))
        .when(w.endswith("es") & (n > 4), cut(2))
        .when(w.endswith("s") & ~w.endswith("ss") & (n > 3), cut(1))
        .otherwise(w)
    )
    return F.when(one.endswith("e") & (F.length(one) > 3), F.substring(one, F.lit(1), F.length(one) - 1)).otherwise(one)


def stems_of(c: Column) -> Column:
    """Distinct stems of a text's words, each distinct word being stemmed once."""
    return F.array_distinct(F.transform(F.array_distinct(words_of(c)), stem))


def words_with_stem(s: str) -> list[str]:
    """All Latin words whose stem is s: the rules of stem, read backwards."""
    cut = {s, s + "e"}
    grown = {w + ending for w in cut for ending in ("", "s", "es", "ed", "ing")} | {w[:-1] + "ies" for w in cut if w.endswith("y")}
    return sorted(w for w in grown if stem_word(w) == s)


def matched_stems(c: Column, stems: list[str]) -> Column:
    """Which of the given stems a text's words have, without stemming the text: for
    Latin stems the words that have them are looked up, CJK tokens as words_of makes
    them: pairs anywhere, others as whole runs."""
    low = F.lower(c)
    by = {s: words_with_stem(s) for s in stems if s.isascii()}
    known = sorted({w for ws in by.values() for w in ws})
    found = F.array_intersect(F.regexp_extract_all(low, F.lit("[a-z]+"), F.lit(0)), array_of(known)) if known else F.expr("cast(array() as array<string>)")

    def held(words: Column) -> Column:
        out = []
        for s in stems:
            if s in by:
                has = F.arrays_overlap(words, array_of(by[s])) if by[s] else F.lit(False)
            elif len(s) == 2:
                has = F.contains(low, F.lit(s))
            else:
                has = low.rlike(f"(?<![一-鿿]){s}(?![一-鿿])")
            out.append(F.when(has, F.lit(s)))
        return F.array_compact(F.array(*out)) if out else F.expr("cast(array() as array<string>)")

    # a lambda, so that the words are taken from the text once
    return F.element_at(F.transform(F.array(found), held), 1)


def query_words(query: str) -> list[str]:
    """words_of for one query, on the driver."""
    low, out = query.lower(), []
    out += re.findall("[a-z]+", low)
    for run in re.findall("[一-鿿]+", low):
        out += [run] if len(run) == 1 else [run, *(run[i : i + 2] for i in range(len(run) - 1))]
    return out


def stem_word(w: str) -> str:
    """stem for one word, on the driver."""
    for ending, least, put in (("ies", 4, "y"), ("ing", 5, ""), ("ed", 4, ""), ("es", 4, "")):
        if w.endswith(ending) and len(w) > least:
            w = w[: -len(ending)] + put
            break
    else:
        if w.endswith("s") and not w.endswith("ss") and len(w) > 3:
            w = w[:-1]
    return w[:-1] if w.endswith("e") and len(w) > 3 else w


def query_stems(query: str) -> list[str]:
    return sorted({stem_word(w) for w in query_words(query) if w not in STOPWORDS})


# The openings of a question, and vague nouns, that describe nothing.
OPENING = r"^(what|when|where|who|why|how|which|would|did|does|is|are|has|have|do)\s+"
VAGUE = r"\b(kind|type|sort) of\b"


def key_descriptors(query: str) -> list[str]:
    q = re.sub(VAGUE, " ", re.sub(OPENING, "", query.lower()))
    return sorted({stem_word(w) for w in query_words(q) if len(w) > 3 and w not in STOPWORDS and w not in LIGHT_WORDS})


def is_list_question(query: str) -> bool:
    q = query.lower().strip()
    return bool(re.match(r"(what|which|list|name)\b", q)) and any(t in q for t in LIST_TOKENS)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 when both are empty."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def masked_tokens(text: Column, names: Column) -> Column:
    """Distinct words after the given names are blanked, in turn."""
    blanked = F.aggregate(names, F.lower(text), lambda acc, n: F.when(F.length(n) > 0, F.replace(acc, F.lower(n), F.lit(" "))).otherwise(acc))
    return F.array_distinct(words_of(blanked))


def predicate_tokens(c: Column) -> Column:
    bare = F.lower(F.regexp_replace(c, f"[{CJK_NEGATION}]", ""))
    parts = F.filter(F.split(bare, "[^a-z0-9一-鿿]+"), lambda t: F.length(t) > 0)
    parts = F.array_except(parts, array_of(NEGATIONS + LIGHT_VERBS))
    return F.array_distinct(F.transform(parts, lambda t: F.when((F.length(t) > 3) & t.endswith("s") & ~t.endswith("ss"), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t)))


def state_family(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, f"^({'|'.join(STATE_PREFIXES)})", 1), F.lit(""))


def clean_field(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t.isin(PLACEHOLDERS), "").otherwise(t)


def literal_kind(c: Column) -> Column:
    t = F.trim(c)
    return reduce(lambda acc, kp: acc.when(t.rlike(kp[1]), kp[0]), LITERAL_KINDS[1:], F.when(t.rlike(LITERAL_KINDS[0][1]), LITERAL_KINDS[0][0]))


def scrub_secrets(c: Column) -> Column:
    return reduce(lambda acc, pr: F.regexp_replace(acc, pr[0], pr[1]), SECRETS, c)


def truncate(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 1), F.lit("…"))).otherwise(c)


CAP, HEAD, CAP_MARK = 20_000, 12_000, "\n[...]\n"


def cap_text(c: Column) -> Column:
    """Texts over CAP keep their head (60 %) and tail around a mark."""
    tail = CAP - HEAD - len(CAP_MARK)
    return F.when(F.length(c) > CAP, F.concat(F.substring(c, 1, HEAD), F.lit(CAP_MARK), F.right(c, F.lit(tail)))).otherwise(c)


def distill(c: Column) -> Column:
    """The last line that asks, after its last colon if the rest still asks; short texts whole."""
    lines = F.filter(F.transform(F.split(c, "\n", -1), lambda x: F.trim(x)), lambda x: x.rlike("[?？]"))
    line = F.try_element_at(lines, F.lit(-1))
    tail = F.regexp_extract(line, r"^.*(?:: |：)(.*)$", 1)
    asked = F.when(tail.rlike("[?？]"), tail).otherwise(line)
    return F.when(F.length(c) <= 300, c).otherwise(F.coalesce(asked, c))


def memory_line(time_expr: Column, event_time: Column, mention_time: Column, text: Column, details: Column, superseded: Column) -> Column:
    when = F.coalesce(F.nullif(time_expr, F.lit("")), F.date_format(event_time, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.date_format(mention_time, "yyyy-MM-dd"))
    more = F.when(F.length(details) > 0, F.concat(F.lit(" ("), details, F.lit(")"))).otherwise("")
    stale = F.when(superseded.isNotNull(), " [superseded — newer value exists]").otherwise("")
    return F.concat(F.lit("- ["), when, F.lit("] "), text, more, stale)


def render(template: str, values: dict[str, str]) -> str:
    """One-pass {token} substitution; unknown tokens stay, values aren't rescanned."""
    return re.sub(r"\{[a-z_]+\}", lambda m: values.get(m.group(), m.group()), template)


def html_safe_json(c: Column) -> Column:
    return F.replace(F.to_json(c), F.lit("<"), F.lit("\\u003c"))


def glob_pattern(glob: str) -> str:
    """A route glob as a pattern: case-insensitive, * for any run."""
    return "(?i)^" + ".*".join(map(re.escape, glob.split("*"))) + "$"
