"""Personal data and secrets: seed entities, and what the contexts that they teach find."""

from __future__ import annotations

import re
from bisect import bisect_left
from hashlib import sha256
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, documents, giving_back, small_batches, written

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = 4  # the kinds of the fixed patterns; the method adds spans of these and secrets
#: One in so many of the distinct strings that are given a name such as token seeds the secrets, by its
#: hash; all others, named or not, must be found by contexts.
SEED_SHARE = 4

# The patterns whose matches must be found.  The lookbehind only keeps a run of digits
# from being tried again from its middle, where it must fail as well.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

_ANY = re.compile(r"[0-9@]")
_NUMERIC = re.compile(r"[0-9][0-9()+./\x20-]*[0-9]")
_AT = re.compile(r"[^\s@]{1,64}@[^\s@]{1,64}")
_KEY = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{12,512}(?![A-Za-z0-9_-])")
_NAMED = re.compile(r"(?:token|secret|passw(?:or)?d|api[_-]?key)[\"']?[\x20\t]{0,8}[:=][\x20\t]{0,8}[\"'][\"']?", re.I)  # names whose strings may seed secrets
_TOKENS = re.compile(r"[^\W\d_]+|[^\w\s]")
_DIGIT, _LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")
_RUNS = re.compile(r"[0-9]+|[A-Za-z]+")

CONTEXT = 80  # characters on either side of an identifier in which its context is looked for
MARKS = 3  # punctuation marks between an identifier and its context word, at most
SUPPORT = 5  # distinct known instances of a kind that a pattern must have
GENERIC = 3  # kinds of seeds from which a pattern says nothing on the kind
SURE = 0.9  # confidence from which patterns and instances count
#: What an instance of which nothing is known counts against a pattern, one known to be none of the kind
#: being 1; of secrets, of which but a share is seeded, that share of it.
UNKNOWN = 0.1


def luhn(digits: str) -> bool:
    total = 0
    for n, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if n % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x)
    return total % 10 == 0


def emails(text: str):
    """Matches from each @ outwards: its longest run of local characters to the left, not before the
    match before it, and a domain to the right.  Equal to a search from the left, but linear."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted, of the fixed patterns."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(d := p.lstrip("0")) < 4 and int(d or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := re.sub(r"[^0-9]", "", m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def digest(spans) -> str:
    return sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()


def _shapes(number: str) -> tuple[int, int]:
    """The kinds that a number could be by its digits and points, and those that it is known not to be, as bits."""
    digits = re.sub(r"[^0-9]", "", number)
    n = len(digits)
    if n < 7:
        return 0, 0
    card = (12 <= n <= 19) << 2
    points = (number.count(".") >= 3) << 1
    address = points and all(len(d := p.lstrip("0")) < 4 and int(d or 0) <= 255 for p in re.findall(r"[0-9]+", number))
    fails = (card if not luhn(digits) else 0) | (points if not address else 0)
    return (((n <= 15) << 3) | card | points) & ~fails, fails


def secrets(text: str):
    """Strings in quotes that are given a name such as token or password."""
    for m in _NAMED.finditer(text):
        if found := _KEY.match(text, m.end()):
            if _DIGIT.search(found[0]) and _LETTER.search(found[0]):
                yield found.start(), found.end()


def contexts(text: str, a: int, b: int) -> list[str]:
    """The patterns around text[a:b]: the word before it, the two words before, those
    before and after, the word before with the string's shape, and the word after if marks stand in
    between; each with these marks."""
    left = [x.lower() for x in _TOKENS.findall(text[max(0, a - CONTEXT) : a])]
    right = [x.lower() for x in _TOKENS.findall(text[b : b + CONTEXT])[: MARKS + 1]]
    words = [n for n, x in enumerate(left) if x[0].isalpha()]
    after = next((n for n, x in enumerate(right) if x[0].isalpha()), None)
    out = []
    if words and len(left) - words[-1] - 1 <= MARKS:
        one = " ".join(left[words[-1] :])
        out.append(f"before {one}")
        out.append(f"shape {one} {_RUNS.sub(lambda m: '9' if m[0][0].isdigit() else 'a', text[a : min(b, a + CONTEXT)])}")
        if len(words) > 1:
            out.append(f"before {' '.join(left[words[-2] :][: 2 * MARKS + 2])}")
        if after is not None:
            out.append(f"around {one} _ {' '.join(right[: after + 1])}")
    if after:
        out.append(f"after {' '.join(right[: after + 1])}")
    return out


def candidates(text: str, spans) -> list[tuple]:
    """(context patterns, instance, kinds it could be as bits, kinds it is not as bits, seed kind or -1,
    start, end) of the seeds (the spans given and a share of the strings with the name of a secret), of the
    other strings with such a name, and of those that look like an identifier and overlap none of these."""
    found = []
    for a, k, b in spans:
        could, fails = _shapes(text[a:b]) if k else (0, 0)
        found.append((a, b, 1 << k | could, fails & ~(1 << k), k))
    named = [(a, b) for a, b in secrets(text)]
    found += [(a, b, 16, 0, 4 if crc32(text[a:b].encode()) % SEED_SHARE == 0 else -1) for a, b in named]
    starts, ends = [], []  # of the union of the spans and the named strings
    for a, b in sorted([(a, b) for a, _, b in spans] + named):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)

    def free(a: int, b: int) -> bool:
        n = bisect_left(starts, b)
        return n == 0 or ends[n - 1] <= a

    def apart(a: int, b: int) -> bool:
        return not (text[a - 1 : a].isalnum() if a else False) and not text[b : b + 1].isalnum()

    for m in _NUMERIC.finditer(text):
        if any(kinds := _shapes(m[0])) and apart(m.start(), m.end()) and free(m.start(), m.end()):
            found.append((m.start(), m.end(), *kinds, -1))
    if "@" in text:
        found += [(m.start(), m.end(), 1, 0, -1) for m in _AT.finditer(text) if free(m.start(), m.end())]
    for m in _KEY.finditer(text):
        if _DIGIT.search(m[0]) and _LETTER.search(m[0]) and free(m.start(), m.end()):
            found.append((m.start(), m.end(), 16, 0, -1))
    return [(contexts(text, a, b), text[a:b], kinds, fails, seed, a, b) for a, b, kinds, fails, seed in found]


_FIELDS = ("patterns", "instance", "kinds", "fails", "seed", "start", "end")
_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
_CAND = pa.struct(list(zip(_FIELDS, (pa.list_(pa.string()), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))))
_OUT = ", ".join(f"n_{k} long" for k in KINDS[:BASE_KINDS]) + ", base_sha256 string, base array<struct<start:long,kind:int,end:long>>"
_OUT += ", found array<struct<patterns:array<string>,instance:string,kinds:int,fails:int,seed:int,start:long,end:long>>"


def _find(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            texts = part.column("text").to_pylist()
            spans = [base_spans(t) if t and _ANY.search(t) else [] for t in texts]
            found = [candidates(t, s) if t and _ANY.search(t) else [] for t, s in zip(texts, spans)]
            counts = [pa.array([sum(k == n for _, k, _ in s) for s in spans], pa.int64()) for n in range(BASE_KINDS)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("row"), part.column("doc_id"), *counts, pa.array([digest(s) for s in spans]),
                    pa.array([[{"start": a, "kind": k, "end": b} for a, k, b in s] for s in spans], pa.list_(_SPAN)),
                    pa.array([[dict(zip(_FIELDS, c)) for c in f] for f in found], pa.list_(_CAND)),
                ],
                ["row", "doc_id", *[f"n_{k}" for k in KINDS[:BASE_KINDS]], "base_sha256", "base", "found"],
            )


def bootstrapped(found: DataFrame, size: int, support: int = SUPPORT, sure: float = SURE) -> DataFrame:
    """node, n: the contexts to trust, as kind:pattern, and the number of distinct instances of each.
    ``found``: pattern, instance, kinds, fails, seed; ``size`` is the number of its rows.

    The graph joins patterns (the words around an identifier) and instances, for each kind that an
    instance could be by its shape.  Seeds have score 1 for their kind and are known not to be of
    another, as are strings that fail the kind's check (Luhn, parts of an address).  Each round, a
    pattern's confidence for a kind is the sum of its known instances' scores over that sum, the number
    of instances known to be none and ``UNKNOWN`` times the number of the rest.  Patterns with enough
    known instances and confidence, unless seeds of ``GENERIC`` kinds have them, pass it on, and an
    instance of several trusted patterns is wrong only if all of them are.  A trusted pattern stays trusted, and rounds go on until none is added.
    """
    edges = written(found.groupBy("pattern", "instance").agg(F.bit_or("kinds").alias("kinds"), F.bit_or("fails").alias("fails"), F.max("seed").alias("seed")), "graph", rows=size)
    kinds = F.explode(F.array(*[F.lit(n) for n in range(len(KINDS))]))
    rows = edges.withColumn("kind", kinds).where(F.expr("seed = kind or ((kinds | fails) & shiftleft(1, kind)) > 0"))
    other = F.expr("seed >= 0 and seed != kind or seed < 0 and (fails & shiftleft(1, kind)) > 0")
    key = lambda c: F.concat_ws(":", "kind", c)
    rows = written(rows.select(key("pattern").alias("node"), key("instance").alias("leaf"), (F.col("seed") == F.col("kind")).alias("seed"), other.alias("other")), "nodes", rows=2 * size)
    total = rows.count()
    # a pattern or an instance may have a large share of all edges, so the joins deal these by chance
    leaves = written(rows.groupBy("leaf").agg(F.bool_or("seed").alias("seed"), F.count("*").alias("edges")), "leaves", rows=size)
    nodes = written(rows.groupBy("node").agg(F.count("*").alias("n"), F.bool_or("seed").alias("seed")).withColumn("pattern", F.expr("substr(node, 3)")), "degrees", rows=2 * size)
    generic = nodes.where("seed").groupBy("pattern").count().where(f"count >= {GENERIC}")
    nodes = written(nodes.join(generic, "pattern", "left_anti").select("node", "n"), "specific", rows=2 * size)
    scores, trusted, last = leaves.where("seed").select("leaf", "edges", F.lit(1.0).alias("score")), None, 0
    doubt = F.when(F.col("node").startswith(f"{BASE_KINDS}:"), UNKNOWN / SEED_SHARE).otherwise(UNKNOWN)
    while True:
        known = attach(rows, scores, "leaf", "edges", total).withColumn("score", F.when(~F.col("other"), F.col("score")))
        known = known.groupBy("node").agg(
            F.sum("score").alias("score"), F.count("score").alias("have"), F.sum(F.col("other").cast("int")).alias("others"), F.sum((F.col("score").isNull() & ~F.col("other")).cast("int")).alias("unknown")
        )
        known = known.where(F.col("have") >= support).withColumn("trust", F.col("score") / (F.col("score") + F.col("others") + doubt * F.col("unknown")))
        known = known.where(F.col("trust") >= sure).select("node", "trust")
        if trusted is not None:
            known = known.unionByName(trusted.select("node", "trust")).groupBy("node").agg(F.max("trust").alias("trust"))
        trusted = written(known.join(nodes, "node"), "patterns", rows=size)
        now = trusted.count()
        if now == last:
            return trusted.select("node", "n")
        last = now
        new = attach(rows.where("not seed and not other"), trusted, "node", "n", total).where("trust is not null")
        new = new.groupBy("leaf").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("trust"), F.lit(0.0)) + 1e-9)))).alias("score")).where(F.col("score") >= sure)
        both = leaves.where("seed").select("leaf", F.lit(1.0).alias("score")).unionByName(new)
        scores = written(both.groupBy("leaf").agg(F.max("score").alias("score")).join(leaves.select("leaf", "edges"), "leaf"), "instances", rows=size)


def personal(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans of every document.

    The counts and base_sha256 are those of the fixed patterns; spans lists these and what the trusted
    contexts find, as kind:start:end in code points, by start and then kind.  Such a find has the shape of
    its kind, passes its check (Luhn, parts of an address) and overlaps no span of the fixed patterns.
    A secret is a string of 12 to 512 letters, digits, - and _ with at least one letter and one digit;
    it is listed only if a trusted context holds it, whether it was a seed or not, so a table with too
    few of them (``SUPPORT`` distinct seeds in one context) has none.  An address without a domain has at
    most 64 characters on either side of its @.  n_spans is the number of spans.

    Null text is empty; documents without identifiers have zeros and empty spans; a very long text is
    searched whole, and a context is the ``CONTEXT`` characters on either side; rows that repeat are each
    searched; columns but doc_id and text are left out; an empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    small_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    base = written(rows.mapInArrow(giving_back(_find), f"row long, doc_id {kind}, {_OUT}"), "identifiers")
    found = base.select("row", F.explode("found").alias("f")).select("row", "f.*")
    each = found.select("row", F.explode("patterns").alias("pattern"), "instance", "kinds", "fails", "seed", "start", "end")
    size = found.select(F.sum(F.size("patterns"))).first()[0] or 0
    trusted = bootstrapped(each.drop("row", "start", "end"), size, **options)
    kinds = F.explode(F.filter(F.array(*[F.lit(n) for n in range(len(KINDS))]), lambda k: F.col("kinds").bitwiseAND(F.call_function("shiftleft", F.lit(1), k)) > 0))
    open_ = each.where(f"seed < 0 or seed >= {BASE_KINDS}").select("row", "pattern", "start", "end", kinds.alias("kind"))
    open_ = open_.withColumn("node", F.concat_ws(":", "kind", "pattern"))
    sizes = open_.groupBy("node").agg(F.count("*").alias("n")).join(trusted.select("node"), "node").withColumn("trusted", F.lit(True))
    more = attach(open_, written(sizes, "trusted", rows=size), "node", "n", size).where("trusted").select("row", "start", "kind", "end")
    more = more.groupBy("row").agg(F.collect_set(F.struct("start", "kind", "end")).alias("more"))
    every = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))))
    names = F.array(*[F.lit(k) for k in KINDS])
    text = F.array_join(F.transform(every, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
    return base.join(more, "row", "left").select("doc_id", *[f"n_{k}" for k in KINDS[:BASE_KINDS]], "base_sha256", text.alias("spans"), F.size(every).cast("long").alias("n_spans"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal(documents(spark, sf_dir))


BASE_SQL = r"""
WITH found AS (
  SELECT doc_id,
         regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS emails,
         regexp_extract_all(coalesce(text, ''), '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ips,
         list_transform(regexp_extract_all(coalesce(text, ''), '[0-9]([\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS cards,
         list_transform(regexp_extract_all(coalesce(text, ''), '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS phones
  FROM documents)
SELECT doc_id, len(emails)::BIGINT AS n_email,
       len(list_filter(ips, lambda x: len(list_filter(string_split(x, '.'), lambda y: y::HUGEINT > 255)) = 0))::BIGINT AS n_ip,
       len(list_filter(cards, lambda x: len(x) BETWEEN 14 AND 19 AND
         list_sum(list_transform(range(1, len(x) + 1), lambda i: CASE
           WHEN i % 2 = 1 THEN reverse(x)[i]::INT WHEN reverse(x)[i]::INT > 4 THEN reverse(x)[i]::INT * 2 - 9 ELSE reverse(x)[i]::INT * 2 END)) % 10 = 0))::BIGINT AS n_card,
       len(list_filter(phones, lambda x: len(x) BETWEEN 10 AND 15))::BIGINT AS n_phone
FROM found
"""
