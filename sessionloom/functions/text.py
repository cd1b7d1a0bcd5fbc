"""Scalar expressions on text: ids, fingerprints, redaction, clipping, time stamps, paths, keyword classes."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(*parts: Column, length: int = 16) -> Column:
    """First hex digits of sha256 over the parts joined by |; a null part reads None."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts]), 256), 1, length)


def hmac_id(key: str, text: Column, length: int = 32) -> Column:
    """First hex digits of HMAC-SHA256 under a key, by the definition: two nested digests over the padded key."""
    padded = key.encode().ljust(64, b"\0")
    if len(padded) > 64:
        raise ValueError("a key has at most 64 bytes")
    inner, outer = (F.lit(bytes(b ^ pad for b in padded)) for pad in (0x36, 0x5C))
    digest = F.unhex(F.sha2(F.concat(inner, F.coalesce(text, F.lit("")).cast("binary")), 256))
    return F.substring(F.sha2(F.concat(outer, digest), 256), 1, length)


def fingerprint(text: Column) -> Column:
    """White space runs as one space, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


#: Nine patterns replaced as a whole, and four keywords of which the keyword stays and the value goes.
SECRETS = [
    r"(?i)\bsk-ant-[A-Za-z0-9_\-]{20,}",
    r"(?i)\bsk-[A-Za-z0-9_\-]{12,}",
    r"(?i)Bearer\s+[A-Za-z0-9_\-\.]{20,}",
    r"(?i)tok_[A-Za-z0-9]{20,}",
    r"(?i)AKIA[0-9A-Z]{16}",
    r"(?i)gh[pousr]_[A-Za-z0-9]{36,}",
    r"(?i)-----BEGIN [A-Z ]+PRIVATE KEY-----[\s\S]*?-----END [A-Z ]+PRIVATE KEY-----",
    r"(?i)mongodb(\+srv)?://[^\s'\"]+",
    r"(?i)postgres(ql)?://[^\s'\"]+",
]
KEYWORDS = ["password", "secret", "token", "api[_-]?key"]
MASK = "REDACTED_SECRET"
KEYED = [rf"(?i)({word}\"?\s*[=:]\s*\"?)([^\s'\"]{{8,}})" for word in KEYWORDS]
#: What a pattern needs to match, in lower case, one list a pattern: a text without any of it is not searched for the pattern.
NEEDED = [["sk-ant-"], ["sk-"], ["bearer"], ["tok_"], ["akia"], [f"gh{c}_" for c in "pousr"], ["-----begin "], ["mongodb"], ["postgres"], ["password"], ["secret"], ["token"], ["apikey", "api_key", "api-key"]]


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once."""
    return F.transform(F.array(value), use)[0]


#: Where the patterns are cut in groups: what a text has of an earlier group alone decides which patterns it is searched for.
_GROUPS = [0, len(SECRETS), len(SECRETS) + 2, len(NEEDED)]


def _has(low: Column, first: int = 0, end: int = len(NEEDED)) -> Column:
    """Whether a text in lower case has what any of these patterns needs."""
    words = dict.fromkeys(w for needed in NEEDED[first:end] for w in needed)
    return functools.reduce(Column.__or__, [low.contains(w) for w in words])


def redact(text: Column, literals: list[str] = ()) -> Column:
    """Secrets masked by pattern, then known literal secrets, the longest first. Cheap tests spare clean texts the rest.

    Patterns before the first one that can match are left out. Those behind it are not, as a mask may bring in what they need.
    """
    rules = [*((p, MASK) for p in SECRETS), *((p, "$1" + MASK) for p in KEYED)]

    def masked(c: Column, low: Column) -> Column:
        cases = F
        for first, end in itertools.pairwise(_GROUPS):
            cases = cases.when(_has(low, first, end), functools.reduce(lambda out, rule: F.regexp_replace(out, *rule), rules[first:], c))
        return cases.otherwise(c)

    out = _bound(text, lambda c: _bound(F.lower(c), lambda low: masked(c, low)))
    return functools.reduce(lambda c, s: F.replace(c, F.lit(s), F.lit(MASK)), sorted(literals, key=lambda s: (-len(s), s)), out)


#: The tokens of a JSON text: strings, structure, white space, all else.
JSON_TOKEN = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[{}\[\]:,]|\s+|[^"{}\[\]:,\s]+'


def _numbered_keys(tokens: Column) -> Column:
    """Tokens (t, key: whether it names a field) as text, equal keys of one object numbered."""
    none = F.expr("cast(array() as array<string>)")
    with_number = lambda t, n: F.concat(F.substring(t, F.lit(1), F.length(t) - 1), F.lit("#"), n.cast("string"), F.lit('"'))

    def named(own: Column, t: Column) -> Column:
        free = F.filter(F.sequence(F.lit(2), F.size(own) + 2), lambda n: ~F.array_contains(own, with_number(t, n)))
        return F.when(F.array_contains(own, t), with_number(t, free[0])).otherwise(t)

    def step(s: Column, x: Column) -> Column:
        """seen: the keys met so far of every object that is open; new: the keys that take a number, with their places."""
        above = F.slice(s["seen"], F.lit(1), F.size(s["seen"]) - 1)

        def met(own: Column, key: Column) -> Column:
            new = F.when(key != x["t"], F.concat(s["new"], F.array(F.struct(x["at"].alias("at"), key.alias("t"))))).otherwise(s["new"])
            return F.struct(F.concat(above, F.array(F.concat(own, F.array(key)))).alias("seen"), new.alias("new"))

        key = _bound(F.element_at(s["seen"], -1), lambda own: _bound(named(own, x["t"]), lambda key: met(own, key)))
        opened = F.concat(s["seen"], F.array(none))
        return F.when(x["key"], key).otherwise(F.struct(F.when(x["t"] == "{", opened).otherwise(above).alias("seen"), s["new"].alias("new")))

    placed = F.transform(tokens, lambda x, i: F.struct(x["t"].alias("t"), x["key"].alias("key"), i.alias("at")))
    marks = F.filter(placed, lambda x: x["key"] | (x["t"] == "{") | (x["t"] == "}"))
    start = F.struct(F.expr("array(cast(array() as array<string>))").alias("seen"), F.expr("cast(array() as array<struct<at: int, t: string>>)").alias("new"))
    numbered = F.map_from_entries(F.aggregate(marks, start, step, lambda s: s["new"]))
    return _bound(numbered, lambda new: F.array_join(F.transform(tokens, lambda x, i: F.coalesce(new[i], x["t"])), ""))


def redact_json(json: Column) -> Column:
    """Every string of a JSON text masked by itself, values and keys at any depth; numbers and structure stay.

    Of keys of one object that are equal once masked, all but the first are numbered from #2 on, past numbers that the
    object has already. A text that is no JSON is masked as a text.
    """
    masked = lambda t: F.when(t.startswith('"'), F.concat(F.lit('"'), redact(F.substring(t, F.lit(2), F.length(t) - 2)), F.lit('"'))).otherwise(t)
    colon = lambda ts, i: (F.get(ts, i + 1) == ":") | (F.get(ts, i + 1).rlike(r"^\s") & (F.get(ts, i + 2) == ":"))
    marked = lambda ts: F.transform(ts, lambda t, i: F.struct(masked(t).alias("t"), (t.startswith('"') & F.coalesce(colon(ts, i), F.lit(False))).alias("key")))
    plain = lambda m: F.array_join(F.transform(m, lambda x: x["t"]), "")
    collide = lambda m: F.size(F.filter(m, lambda x: x["key"] & x["t"].contains(MASK))) > 1
    whole = lambda j: _bound(_bound(F.regexp_extract_all(j, F.lit(JSON_TOKEN), F.lit(0)), marked), lambda m: F.when(collide(m), _numbered_keys(m)).otherwise(plain(m)))
    return _bound(json, lambda j: F.when(~_bound(F.lower(j), lambda low: _has(low)), j).when(F.try_parse_json(j).isNull(), redact(j)).otherwise(whole(j)))


def redact_bytes(data: Column, literals: list[str] = ()) -> Column:
    """Bytes as UTF-8 text, what is none replaced, masked."""
    return redact(F.make_valid_utf8(data.cast("string")), literals)


def leaks(text: Column, literals: list[str] = ()) -> Column:
    """Whether redaction would change the text."""
    return F.coalesce(redact(text, literals) != text, F.lit(False))


def clip(text: Column, limit: int) -> Column:
    """At most limit characters and an ellipsis; a last word that the cut severs goes where it looks like a path or URL."""
    head = F.substring(text, 1, limit)
    tail = F.substring_index(head, " ", -1)
    severed = ~F.substring(text, limit + 1, 1).rlike(r"(?U)^\s") & tail.contains("/")
    kept = F.when(severed, F.substring(head, F.lit(1), F.length(head) - F.length(tail))).otherwise(head)
    return F.when(F.length(text) > limit, F.concat(F.regexp_replace(kept, r"(?U)\s+$", ""), F.lit("…"))).otherwise(text)


def truncate(text: Column, width: int) -> Column:
    """One line of at most width characters, the last of them an ellipsis where the text is longer."""
    line = F.trim(F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" ")))
    return F.when(F.length(line) > width, F.concat(F.substring(line, 1, width - 1), F.lit("…"))).otherwise(line)


#: Scratch paths and skill references that stand in quoted prose, and what takes their place.
EPHEMERAL = r"(?:/private)?/tmp/[^\s'`\"<>)\],]+"
EPHEMERAL_TOKEN = "<<ephemeral-runtime-path>>"
SKILL_REFERENCE = r"Skill\(|/skill:|@skill"
SKILL_TOKEN = "<<quoted-skill-ref>>"


def defang(text: Column) -> Column:
    """Quoted prose without paths and references that a reader or tool could follow."""
    return F.regexp_replace(F.regexp_replace(text, EPHEMERAL, EPHEMERAL_TOKEN), SKILL_REFERENCE, SKILL_TOKEN)


def sections(markdown: Column) -> Column:
    """Array of (title, body) of the second-level headings of a Markdown text; what precedes the first one is left out."""
    parts = F.split(F.concat(F.lit("\n"), markdown), r"\n## ")
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    named = lambda p: F.struct(bare(F.substring_index(p, "\n", 1)).alias("title"), F.when(F.locate("\n", p) > 0, bare(F.regexp_replace(p, r"^[^\n]*\n", ""))).otherwise("").alias("body"))
    return F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), named)


def without_skills(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)<skill\b[^>]*>.*?</skill>", "")


def absolute_paths(text: Column) -> Column:
    """Distinct absolute paths under the usual roots in order of appearance, without punctuation at their end."""
    found = F.regexp_extract_all(text, F.lit(r"(?<!\w)(/(?:Users|tmp|var|opt|private)/[^\s'`\"<>)\],]+)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda p: F.regexp_replace(p, r"[.,;:]+$", "")))


def html_escape(text: Column) -> Column:
    for plain, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def script_json(json: Column) -> Column:
    """JSON that can stand in a script element: no character that could close it."""
    for plain, coded in (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029")):
        json = F.replace(json, F.lit(plain), F.lit(coded))
    return json


def iso_to_ms(text: Column) -> Column:
    """ISO-8601 to epoch milliseconds; what cannot be read is 0."""
    return F.coalesce(F.unix_millis(F.try_to_timestamp(text)), F.lit(0).cast("long"))


def ms_to_iso(ms: Column, unknown: str = "unknown") -> Column:
    """Epoch milliseconds to seconds of UTC; null and 0 are unknown. The session's time zone plays no part."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / 86_400_000).cast("int"))
    second = F.floor(F.pmod(ms, F.lit(86_400_000)) / 1000)
    two = lambda c: F.lpad(F.floor(c).cast("string"), 2, "0")
    clock = F.concat(two(second / 3600), F.lit(":"), two(second % 3600 / 60), F.lit(":"), two(second % 60))
    return F.when(F.coalesce(ms, F.lit(0)) == 0, unknown).otherwise(F.concat(day.cast("string"), F.lit("T"), clock, F.lit("Z")))


def tenths(ms: Column) -> Column:
    """Tenths of a second below a minute, rounded as the double ms / 1000 is: half a tenth goes where its binary value lies,
    and to the even tenth where that is the half itself. Held to whole numbers: no double below 2**6 that is a half has a
    bit beyond 2**-57."""
    below = F.least(ms, F.lit(60_000))
    exact = (below / F.lit(1000.0) * F.lit(float(2**57))).cast("bigint").cast("decimal(19,0)") * F.lit(Decimal(1000))
    half = below.cast("decimal(5,0)") * F.lit(Decimal(2**57))
    down, rest = F.floor(below / 100), below % 100
    up = (rest > 50) | ((rest == 50) & ((exact > half) | ((exact == half) & (down % 2 == 1))))
    return down + up.cast("int")


def duration(ms: Column) -> Column:
    """Milliseconds as 1.2s or 3m04s; nothing, 0 and what is negative is a dash."""
    whole = F.floor(ms / 1000)
    long = F.concat(F.floor(whole / 60).cast("string"), F.lit("m"), F.lpad((whole % 60).cast("string"), 2, "0"), F.lit("s"))
    count = tenths(ms)
    short = F.concat(F.floor(count / 10).cast("string"), F.lit("."), (count % 10).cast("string"), F.lit("s"))
    return F.when(F.coalesce(ms, F.lit(0)) <= 0, "—").when(ms < 60_000, short).otherwise(long)


def days_between(earlier: Column, later: Column) -> Column:
    return (later - earlier) / F.lit(86_400_000.0)


def is_utc_stamp(text: Column) -> Column:
    """Whether a text is an ISO time stamp of UTC that exists."""
    return F.coalesce(text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|\+00:00)$") & F.try_to_timestamp(text).isNotNull(), F.lit(False))


def canonical_json(text: Column) -> Column:
    """JSON with sorted keys; text that is no JSON stays as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), text)


def evidence_digest(text: Column) -> Column:
    return F.substring(F.sha2(F.coalesce(canonical_json(text), F.lit("")), 256), 1, 16)


def counts_map(json: Column) -> Column:
    """A map of counts from JSON; what cannot be read is an empty map."""
    return F.coalesce(F.from_json(F.when(F.try_parse_json(json).isNotNull(), json), "map<string,bigint>"), F.from_json(F.lit("{}"), "map<string,bigint>"))


#: A key that ends in id once - and _ are out of it and its letters are small; as $ does, it takes a last line end as the end.
ID_SHAPED = r"[iI][_-]*[dD][_-]*(?:(?:\r[_-]*\n|[\n\r\u0085\u2028\u2029])[_-]*)?\z"


def id_shaped(key: Column) -> Column:
    return key.rlike(ID_SHAPED)


def _entries(json: Column) -> Column:
    """Fields of an object in order of key. sort_array orders as array_sort does, without a comparator run pair by pair."""
    return F.sort_array(F.map_entries(F.from_json(json, "map<string,string>")))


def _top_then_nested(json: Column, picked: Callable[[Column], Column]) -> Column:
    """What is picked of an object's fields, then of those of the objects in it. The object is parsed once."""
    nested = lambda top: F.transform(F.filter(top, lambda x: x["value"].startswith("{")), lambda x: picked(_entries(x["value"])))
    return _bound(_entries(json), lambda top: F.concat(picked(top), F.flatten(nested(top))))


def id_values(json: Column) -> Column:
    """Values of an object's id-shaped keys, in order of key; those of nested objects follow."""
    return _top_then_nested(json, lambda e: F.transform(F.filter(e, lambda x: id_shaped(x["key"]) & ~x["value"].startswith("{")), lambda x: x["value"]))


def session_id_of(json: Column) -> Column:
    """The first value under a key that names a session id, the object's own keys before those of nested objects."""
    names = F.array(*map(F.lit, ["sessionid", "nativesessionid", "session"]))
    hit = lambda e: F.transform(F.filter(e, lambda x: F.array_contains(names, F.lower(F.regexp_replace(x["key"], "[_-]", "")))), lambda x: x["value"])
    return F.get(_top_then_nested(json, hit), F.lit(0))


#: The keyword classes, matched as whole words in any case.
DONE = ["done", "completed", "fixed", "all tests pass"]
ERRORS = ["error", "exception", "traceback", "failed", "failure"]
PIVOT = ["actually", "instead", "pivot"]
TODO = ["TODO", "FIXME"]
PENDING = ["next", "still need", "pending", "not yet"]


def has_word(text: Column, words: list[str]) -> Column:
    return text.rlike(r"(?i)\b(" + "|".join(words) + r")\b")


def safe_path(preferred: Column, fallback: Column) -> Column:
    """The first of two paths that is absolute and has no parent step, backslash or NUL; else ''."""
    good = lambda p: p.startswith("/") & ~F.array_contains(F.split(p, "/"), "..") & ~p.contains("\\") & ~p.contains("\0")
    return F.when(good(preferred), preferred).when(good(fallback), fallback).otherwise("")


def project_name(path: Column) -> Column:
    return F.coalesce(F.nullif(F.element_at(F.split(F.rtrim(path, F.lit("/")), "/"), -1), F.lit("")), path)


def plain_path(path: Column) -> Column:
    """Without slashes at the end; the root stays."""
    return F.regexp_replace(path, r"(?<=.)/+$", "")


def under_prefix(path: Column, prefixes: list[str]) -> Column:
    """Whether the path is one of the prefixes or lies under one."""
    return functools.reduce(lambda c, p: c | (path == p) | path.startswith(p + "/"), prefixes, F.lit(False))


def porcelain_path(line: Column) -> Column:
    """Path of a short status line; of a rename, the new one."""
    return F.element_at(F.split(F.substring(line, 4, 1 << 20), " -> "), -1)


def diffstat_path(line: Column) -> Column:
    """Path of a line of change statistics; null for the summary line."""
    return F.when(line.contains("|"), F.trim(F.substring_index(line, "|", 1)))


def relative_evidence(markdown: Column) -> Column:
    """Array of what follows evidence/ in citations that do not name the place from the root; stand-ins in braces or angles
    and the inlined skill blocks are no citations."""
    found = F.regexp_extract_all(without_skills(markdown), F.lit(r"(?U)(?<![\w/])\.?/?evidence/(\S*)"), F.lit(1))
    return F.filter(found, lambda rest: ~rest.rlike(r"[{}<>*]"))


def skill_references(markdown: Column) -> Column:
    """Array of skill references that nothing has resolved."""
    return F.regexp_extract_all(markdown, F.lit(f"({SKILL_REFERENCE})"), F.lit(1))


def cells(line: Column) -> Column:
    """Trimmed cells of a Markdown table row."""
    return F.transform(F.split(F.regexp_replace(F.trim(line), r"^\|+|\|+$", ""), r"\|"), lambda c: F.trim(c))


def is_docs(path: Column) -> Column:
    low = F.lower(F.trim(path))
    return low.startswith("readme") | low.startswith("docs/")


def is_falsifiable(goal: Column) -> Column:
    """Whether a goal names a command and an outcome of it that can be false."""
    return goal.rlike(r"`[^`]+`") & goal.rlike(r"(?i)\b(exits?|prints?|shows?|returns?|contains?|outputs?|status)\b")


def is_observable(criterion: Column) -> Column:
    """Whether a criterion names something that can be seen: output, a status, a file, a screen."""
    return criterion.rlike(r"(?i)\b(exits?|stdout|output|printed|status|body|file|screenshot|renders?|log|line|contains?|quote)\b")


#: A citation without a root with what follows it, and the marks of a stand-in.
CITATION = r"(?U)(?<![\w/])\.?/?evidence/\S*"
STAND_IN = r"[{}<>*]"


def rooted_evidence(text: Column, root: Column) -> Column:
    """A text whose citations of evidence/ name the place from the root; stand-ins stay as they are, to their last sign."""
    cited = F.regexp_extract_all(text, F.lit(f"({CITATION})"), F.lit(1))
    placed = lambda c: F.when(F.regexp_replace(c, r"^\.?/?evidence/", "").rlike(STAND_IN), c).otherwise(F.concat(root, F.lit("/"), F.regexp_replace(c, r"^\.?/?evidence/", "")))
    return F.array_join(F.zip_with(F.split(text, CITATION), cited, lambda between, c: F.concat(between, F.coalesce(placed(c), F.lit("")))), "")
