"""Operator 4: personal data, by fixed patterns and bootstrapped contexts.

E-mail and IP addresses, card and phone numbers are found by their fixed patterns. They are seeds, and so are long strings of
high entropy behind an assignment (secrets). Strings that match a fixed pattern but fail its check are counter-examples; all
other strings of 5 or more characters with a digit are unknown. The words on either side of a string are its lexical patterns.

Spark scores the graph of patterns and instances in turns. A pattern is worth the scores of its instances over all that stand
in it: instances, counter-examples, and ordinary words that the same documents have there. Unknown strings in a pattern worth
enough are promoted: they count as seeds, with the pattern's trust as their score, in the next turn, so chains of patterns lose
trust with every link. When no more are promoted, strings in trusted patterns are personal data: kind `secret` if they have
high entropy behind an assignment, `id` otherwise.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

# fixed values: the patterns, and the order of kinds
KINDS = ("email", "ip", "card", "phone")
LEARNED = ("id", "secret")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TOKEN = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9_./:-]*[A-Za-z0-9])?")
SECRET = re.compile(r"[A-Za-z0-9_+-]{20,}")
ASSIGNED = re.compile(r"[=:]\s*[\"'`]?$")
DIGITS = re.compile(r"[0-9]")
WORD = re.compile(r"\S+")
EDGES = re.compile(r"(\W*+)(?:.*\w)?(\W*)", re.DOTALL)

TRUST, SEEDS, TURNS = 0.8, 5, 6
UNKNOWN = 0.1  # what an unknown string weighs against a pattern: 2.4 of them for each of many seeds are bearable
ENTROPY = 3.0  # bits a character of a secret
LONG = 40  # characters; longer words stand in patterns as their checksum
SALTS = 8


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of a local part, @ and a domain, each @ looked at once."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def matches(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """(kind, start, end, valid) of the fixed patterns' matches, by kind and start; short runs of digits are left out."""
    for a, b in _emails(text):
        yield "email", a, b, True
    if DIGITS.search(text):
        for m in IP.finditer(text):
            yield "ip", *m.span(), all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m[0].split("."))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if len(digits) >= 13:
                yield "card", *m.span(), len(digits) <= 19 and _luhn(digits)
        for m in PHONE.finditer(text):
            yield "phone", *m.span(), 9 <= sum(map(str.isdecimal, m[0])) <= 15


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind and start."""
    return [(kind, a, b) for kind, a, b, valid in matches(text) if valid]


def is_secret(text: str, start: int, end: int) -> bool:
    """Whether a string is long, mixed and random enough, and stands behind an assignment."""
    x = text[start:end]
    if not SECRET.fullmatch(x) or not DIGITS.search(x) or not any(map(str.isalpha, x)) or not ASSIGNED.search(text, max(0, start - 8), start):
        return False
    return -sum(n / len(x) * math.log2(n / len(x)) for n in Counter(x).values()) >= ENTROPY


def shape(instance: str) -> str:
    """Kinds of characters and their number."""
    kinds = {"a" if c.islower() else "A" if c.isupper() else "0" if c.isdecimal() else c for c in instance}
    return "".join(sorted(kinds)) + str(len(instance))


def _plain(word: str) -> str:
    """A word as it stands in patterns: lower case, digits as 0, long ones as a checksum."""
    word = DIGITS.sub("0", word.lower())
    return word if len(word) <= LONG else f"#{zlib.crc32(word.encode('utf-8', 'replace'))}"


def _around(words: list[str], i: int, j: int, prefix: str, suffix: str) -> list[str]:
    """Patterns of what stands in words i to j between prefix and suffix: one to three words before it, one or two after it."""
    before = [f"{' '.join(words[i - k : i])} {prefix}<" for k in (1, 2, 3) if k <= i]
    return before + [f">{suffix} {' '.join(words[j + 1 : j + 1 + k])}" for k in (1, 2) if j + k < len(words)]


def occurrences(text: str) -> tuple[list[tuple[str, int, int]], list[dict], dict[str, int]]:
    """(base spans, the graph's nodes with their patterns, ordinary words that stand in the same patterns).

    label: 1 seed, -1 counter-example, 0 unknown. secret: of high entropy, behind an assignment.
    """
    found = list(matches(text))
    base = [(kind, a, b) for kind, a, b, valid in found if valid]
    tokens = [m.span() for m in TOKEN.finditer(text) if m.end() - m.start() >= 5 and DIGITS.search(m[0])] if DIGITS.search(text) else []
    secrets = [x for x in tokens if is_secret(text, *x)]
    nodes = [(a, b, 1, True) for a, b in secrets]
    # fixed patterns that match within a secret say nothing about its context
    apart = lambda a, b: (k := bisect_right(secrets, (a, len(text)))) == 0 or secrets[k - 1][1] < b
    nodes += [(a, b, 1 if valid else -1, False) for _, a, b, valid in found if apart(a, b)]
    covered, k, reach = sorted((a, b) for a, b, _, _ in nodes), 0, -1
    for a, b in tokens:
        while k < len(covered) and covered[k][0] < b:
            reach, k = max(reach, covered[k][1]), k + 1
        if reach <= a:
            nodes.append((a, b, 0, False))
    if not nodes:
        return base, [], {}
    places = [m.span() for m in WORD.finditer(text)]
    starts = [a for a, _ in places]
    words = [_plain(text[a:b]) for a, b in places]
    met, taken = [], set()
    for a, b, label, secret in nodes:
        i, j = bisect_right(starts, a) - 1, bisect_right(starts, b - 1) - 1
        taken.update(range(i, j + 1))
        prefix, suffix = _plain(text[starts[i] : a]), _plain(text[b : places[j][1]])
        patterns = _around(words, i, j, prefix, suffix)
        form = shape(text[a:b])
        patterns += [f"{form} {p}" for p in _around(words[max(0, i - 1) : j + 2], min(i, 1), min(i, 1) + j - i, prefix, suffix)]
        met.append({"start": a, "end": b, "instance": text[a:b], "label": label, "secret": secret, "patterns": patterns})
    wanted = {p for m in met for p in m["patterns"]}
    last, first = {p[:-1].split(" ")[-2] for p in wanted if p[-1] == "<"}, {p.split(" ")[1] for p in wanted if p[0] == ">"}
    plain: Counter[str] = Counter()
    for i, word in enumerate(words):
        if i in taken or not ((i and words[i - 1] in last) or (i + 1 < len(words) and words[i + 1] in first)):
            continue
        lead, trail = EDGES.fullmatch(word).groups()
        plain.update(p for p in _around(words, i, i, lead, trail) if p in wanted)
    return base, met, plain


SPAN_SQL = "array<struct<kind:string,start:bigint,end:bigint>>"
MET_SQL = "array<struct<start:bigint,end:bigint,instance:string,label:int,secret:boolean,patterns:array<string>>>"
PLAIN_SQL = "array<struct<pattern:string,n:bigint>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_MET = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("instance", pa.string()), ("label", pa.int32()), ("secret", pa.bool_()), ("patterns", pa.list_(pa.string()))]))
_PLAIN = pa.list_(pa.struct([("pattern", pa.string()), ("n", pa.int64())]))


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            base, met, plain = zip(*map(occurrences, batch.column(2).to_pylist()), strict=True)
            spans = pa.array([[{"kind": k, "start": a, "end": e} for k, a, e in b] for b in base], _SPAN)
            counts = pa.array([[{"pattern": p, "n": n} for p, n in x.items()] for x in plain], _PLAIN)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), spans, pa.array(met, _MET), counts], ["id", "mark", "base", "met", "plain"])


def _salted(large: DataFrame, small: DataFrame, key: str, by: str) -> DataFrame:
    """Inner join on key, a hot key of large spread by the column `by`; small is repeated SALTS times."""
    small = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return large.withColumn("salt", F.pmod(F.hash(by), F.lit(SALTS))).join(small, [key, "salt"]).drop("salt")


def trusted_patterns(edges: DataFrame, plain: DataFrame, trust: float = TRUST, seeds: int = SEEDS, turns: int = TURNS) -> DataFrame:
    """(pattern, trust) worth extracting with, of edges (pattern, instance, label) and plain (pattern, n).

    trust = sum of scores / (positive + negative + UNKNOWN * unknown instances + ordinary words + 1), where seeds score 1 and
    promoted instances the best trust of their patterns in the turn that promoted them. A pattern needs `seeds` different
    positive instances. Turns end when none is promoted, or after `turns`.
    """
    strongest = F.max(F.struct(F.abs("label").alias("known"), "label"))["label"]
    once = edges.groupBy("pattern", "instance").agg(strongest.alias("label"))
    scored = stored(once.withColumn("score", F.when(F.col("label") == 1, 1.0)))
    words = stored(plain.groupBy("pattern").agg(F.sum("n").alias("n")))
    for turn in range(turns):
        sums = scored.groupBy("pattern").agg(F.sum("score").alias("worth"), F.count("score").alias("good"), F.count("*").alias("all"), F.count(F.when(F.col("label") == -1, 1)).alias("bad"))
        against = F.col("good") + F.col("bad") + UNKNOWN * (F.col("all") - F.col("good") - F.col("bad")) + F.coalesce("n", F.lit(0)) + 1
        rated = sums.where(F.col("good") >= seeds).join(words, "pattern", "left").select("pattern", (F.col("worth") / against).alias("trust"))
        good = stored(rated.where(F.col("trust") >= trust))
        if turn == turns - 1:
            break
        new = scored.where("label = 0 AND score IS NULL")
        new = stored(_salted(new, good, "pattern", "instance").groupBy("instance").agg(F.max("trust").alias("new")))
        if new.isEmpty():
            break
        known = scored.where("label <> 0 OR score IS NOT NULL")
        open_ = scored.where("label = 0 AND score IS NULL").drop("score")
        scored = stored(known.unionByName(open_.join(new, "instance", "left").withColumnRenamed("new", "score")))
    return good


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trust: float = TRUST, seeds: int = SEEDS) -> DataFrame:
    """One row per row of docs: id, base (spans of the fixed kinds, by kind and start), added (learned spans, by kind and start).

    Null text counts as empty. Rows that repeat an id are searched one by one; rows that repeat id and text get equal spans.
    Texts without a digit and without an @ hold nothing that either way could find, and are not sent to Python. Patterns and
    instances go through the graph as 64-bit hashes.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select("id", F.xxhash64("text").alias("mark"), "text")
    kind = docs.schema[id_col].dataType.simpleString()
    some = F.col("text").rlike("[0-9@]")
    found = stored(rows.where(some).mapInArrow(_search, f"id {kind}, mark bigint, base {SPAN_SQL}, met {MET_SQL}, plain {PLAIN_SQL}"))
    met = found.select("id", "mark", F.explode("met").alias("m")).select("id", "mark", "m.*")
    hashed = met.withColumn("pattern", F.explode("patterns")).withColumns({"pattern": F.xxhash64("pattern"), "instance": F.xxhash64("instance")})
    plain = found.select(F.explode("plain").alias("x")).select(F.xxhash64("x.pattern").alias("pattern"), "x.n")
    good = trusted_patterns(hashed.select("pattern", "instance", "label"), plain, trust, seeds)
    open_ = hashed.where("label = 0 OR secret").select("id", "mark", "start", "end", "secret", "instance", "pattern")
    span = F.struct(F.when(F.col("secret"), LEARNED[1]).otherwise(LEARNED[0]).alias("kind"), "start", "end")
    new = _salted(open_, good.select("pattern"), "pattern", "instance").groupBy("id", "mark").agg(F.array_sort(F.collect_set(span)).alias("added"))
    new = new.select(F.col("id").alias("n_id"), F.col("mark").alias("n_mark"), "added")
    none = F.array().cast(SPAN_SQL)
    out = found.join(new, F.col("id").eqNullSafe(F.col("n_id")) & (F.col("mark") == F.col("n_mark")), "left")
    out = out.select("id", "base", F.coalesce("added", none).alias("added"))
    return out.unionByName(rows.where(~some).select("id", none.alias("base"), none.alias("added"))).withColumnRenamed("id", id_col)


def written(spans: str) -> str:
    """SQL of an array of spans as kind:start:end, comma-joined."""
    return f"array_join(transform({spans}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"
