"""Personal data: fixed forms, and identifiers that their context gives away.

Base: e-mail addresses, IPv4 addresses, card numbers and phone numbers of fixed
forms, found in one linear scan of each text. Secrets, such as access tokens, have no
form that tells them from other strings, only contexts. Both seed a bootstrap:

- mentions are seeds or strings of a plausible shape. Base spans are seeds of their
  kind. Long hexadecimal strings seed the kind ``secret``; they join the result only
  by their context;
- every mention has lexical patterns: the two words before it, the words on either
  side, and the label that assigns it, as ``token = "_"`` or ``phone: _``;
- patterns and instances make a bipartite graph. A pattern's score for a kind is
  the smoothed mean confidence of its distinct instances, in which what is not yet
  known of an instance weighs UNSEEN only: no form is no evidence against it. An
  instance's confidence is 1 for a seed, else the noisy-or of its trusted patterns. Spark
  joins and sums score both in turn, ROUNDS times;
- mentions in a trusted pattern whose instance is confident join the result: seeds that
  their context confirms, and discoveries, which no form gives away. They are told apart.

How well contexts discover is measured by ``discovery``, which hides a share of the seeds
from the bootstrap and counts how many of them come back.

A pattern is trusted when it scores LEAST_PATTERN and holds LEAST_SEEDS distinct
seeds, so chance contexts find nothing: LEAST_SEEDS seeds carry as many unseen
instances, many seeds 1.7 times as many. Instances travel as 64-bit digests, not
as plain personal data. Edges are summed before any shuffle by pattern, a pattern or
instance takes part as one row a distinct neighbour, and the instances of one pattern
meet its score in SALTS parts.

Cases: null is the empty text, with no spans; spans count code points, end
exclusive; found spans never overlap base ones nor each other within a kind;
repeated rows each get their spans; texts of any length are scanned whole; an empty
table gives an empty result; other columns, whatever their names, pass by.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm.rows import fresh_name, keyed_table, row_keyed
from terrafold.runtime import materialise, ship

#: Kinds with a fixed form, then those that only a context gives away.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
SECRET = KINDS.index("secret")
#: Parts in which the instances of a pattern meet its score.
SALTS = 32
ROUNDS = 3
LEAST_SEEDS = 3
LEAST_PATTERN = 0.7
LEAST_INSTANCE = 0.7
SMOOTHING = 0.5
#: What an instance that nothing is known of counts against its patterns, where a seed counts 1 for them.
UNSEEN = 0.25
#: Characters on each side that patterns look at.
CONTEXT = 48

Span = tuple[int, int]

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_TAIL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_NUMBER = re.compile(r"(?<![0-9A-Za-z])[0-9][0-9 ().-]*[0-9](?![0-9A-Za-z])")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+){3}\Z")
_HEX_GROUPS = re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::{1,2}[0-9A-Fa-f]{1,4}){3,7}(?![0-9A-Za-z:])")
_AT = re.compile(r" ?[\[(](?:at|AT|@)[\])] ?")
_SPELLED_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?: ?[\[(](?:dot|DOT)[\])] ?[A-Za-z0-9-]+|\.[A-Za-z0-9-]+)+")
_WORD = re.compile(r"\w+")
#: Strings that may be secrets, and those of them that seed the kind.
_OPAQUE = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{16,}(?![A-Za-z0-9_-])")
_HEX = re.compile(r"[0-9a-f]{32,}|[0-9A-F]{32,}")
#: A word and what assigns it a value, at the end of a context.
_LABEL = re.compile(r"(\w+)([^\w\n]{0,4}[=:][^\w\n]{0,4})\Z")


def _emails(text: str) -> list[Span]:
    """The pattern's leftmost matches, from each @ outwards: a match starts as far left as its run of local characters goes."""
    out: list[Span] = []
    end = 0
    for m in _DOMAIN.finditer(text):
        at = m.start()
        start, width = at, 64
        while start > end:
            low = max(end, at - width)
            tail = _LOCAL_TAIL.search(_tail(text, low, at))
            start = at - len(tail.group()) if tail else at
            if start > low or low == end:
                break
            width *= 8
        if start < at:
            out.append((start, m.end()))
            end = m.end()
    return out


def _tail(text: str, low: int, high: int) -> str:
    """The run of local characters that ends at high, no further left than low."""
    part = text[low:high]
    last = None
    for last in _NOT_LOCAL.finditer(part):
        pass
    return part[last.end() :] if last else part


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> dict[str, list[Span]]:
    """The spans of the fixed forms, by kind, each in order."""
    out: dict[str, list[Span]] = {k: [] for k in BASE_KINDS}
    if "@" in text:
        out["email"] = _emails(text)
    if _DIGIT.search(text):
        if "." in text:
            out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        out["card"] = [m.span() for m in _CARD.finditer(text) if 16 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
        if "+" in text:
            out["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of strings that look like an identifier of a kind without having its form."""
    out = []
    if _DIGIT.search(text):
        out += [("secret", *m.span()) for m in _OPAQUE.finditer(text) if _DIGIT.search(m.group()) and not m.group().replace("-", "").replace("_", "").isdigit()]
        for m in _NUMBER.finditer(text):
            n = len(_digits(m.group()))
            if _DOTTED.match(m.group()):
                out.append(("ip", *m.span()))
            elif 7 <= n <= 15:
                out.append(("phone", *m.span()))
            elif 16 <= n <= 19:
                out.append(("card", *m.span()))
    if ":" in text:
        out += [("ip", *m.span()) for m in _HEX_GROUPS.finditer(text)]
    for m in _AT.finditer(text) if "[" in text or "(" in text else ():
        local, domain = _tail(text, max(0, m.start() - 64), m.start()), _SPELLED_DOMAIN.match(text, m.end())
        if local and domain:
            out.append(("email", m.start() - len(local), domain.end()))
    return out


def _patterns(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns around a span: words are lower-cased, digits are 9."""
    fold = lambda words: [re.sub("[0-9]", "9", w.lower()) for w in words]
    before = text[max(0, start - CONTEXT) : start]
    left = _WORD.findall(before)
    if left and start > CONTEXT and before[0].isalnum():
        left = left[1:]  # it may begin before the context
    left, right = fold(left[-2:]), fold(_WORD.findall(text[end : end + CONTEXT])[:1])
    out = []
    if len(left) == 2:
        out.append(f"{left[0]} {left[1]} _")
    if left and right:
        out.append(f"{left[-1]} _ {right[0]}")
    if label := _LABEL.search(before):
        # the closing mark belongs to the label that opened it
        closing = text[end : end + 1] if label.group(2)[-1] in "\"'<[{(" else ""
        out.append(f"{fold([label.group(1)])[0]}{' '.join(label.group(2).split())}_{closing}")
    return out


def _digest(kind: str, text: str) -> int:
    plain = re.sub(r"[ ().-]", "", text).lower() if kind != "email" else text.lower()
    return int.from_bytes(hashlib.blake2b(plain.encode(), digest_size=8).digest(), "little", signed=True)


_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
_MENTION = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("instance", pa.int64()), ("seed", pa.bool_()), ("hidden", pa.bool_()), ("patterns", pa.list_(pa.string()))])
_SCAN = pa.schema([("row_key", pa.int64()), ("doc_id", pa.int64()), ("spans", pa.list_(_SPAN)), ("mentions", pa.list_(_MENTION))])
_SPAN_SQL = "array<struct<kind: int, start: long, end: long>>"
_SCAN_SQL = f"row_key long, doc_id long, spans {_SPAN_SQL}, mentions array<struct<kind: int, start: long, end: long, instance: long, seed: boolean, hidden: boolean, patterns: array<string>>>"


def scan_text(text: str, hide: int = 0) -> tuple[list[dict], list[dict]]:
    """(base spans, mentions with their patterns) of one text; of the strings that seed secrets, one in ``hide`` by digest is no seed but hidden."""
    base = base_spans(text)
    spans = [{"kind": k, "start": a, "end": b} for k, kind in enumerate(BASE_KINDS) for a, b in base[kind]]
    taken = sorted((x["start"], x["end"]) for x in spans)
    mentions = []

    def note(kind: int, a: int, b: int, seed: bool) -> None:
        if found := _patterns(text, a, b):
            instance = _digest(KINDS[kind], text[a:b])
            hidden = bool(seed and hide and kind == SECRET and instance % hide == 0)
            mentions.append({"kind": kind, "start": a, "end": b, "instance": instance, "seed": seed and not hidden, "hidden": hidden, "patterns": found})

    for x in spans:  # base spans are seeds and need no context to count
        note(x["kind"], x["start"], x["end"], True)
    at, reached = 0, dict.fromkeys(KINDS, 0)
    for kind, a, b in sorted(candidates(text), key=lambda x: (x[1], x[2])):
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if a >= reached[kind] and all(s >= b or e <= a for s, e in taken[at : at + 8]):
            reached[kind] = b
            note(KINDS.index(kind), a, b, kind == "secret" and _HEX.fullmatch(text, a, b) is not None)
    return spans, mentions


def _scan(hide: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [scan_text(t or "", hide) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("row_key"), part.column("doc_id"), pa.array([s for s, _ in found], _SCAN.field("spans").type), pa.array([m for _, m in found], _SCAN.field("mentions").type)], schema=_SCAN)

    return run


def score_patterns(edges: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(trusted patterns: kind, pattern, score; confident instances: kind, instance, confidence).

    edges: kind, pattern, instance, seed; one row for each distinct pair.
    """
    instances = edges.groupBy("kind", "instance").agg(F.max(F.when(F.col("seed"), 1.0).otherwise(0.0)).alias("confidence"))
    known = F.sum("confidence")
    for _ in range(rounds):
        weighed = edges.join(instances, ["kind", "instance"])
        patterns = weighed.groupBy("kind", "pattern").agg((known / (known + UNSEEN * (F.count("*") - known) + SMOOTHING)).alias("score"), F.sum(F.col("seed").cast("int")).alias("seeds"))
        trusted = patterns.where((F.col("score") >= LEAST_PATTERN) & (F.col("seeds") >= LEAST_SEEDS)).select("kind", "pattern", "score")
        trusted = materialise(trusted, "patterns")
        # least() passes over nulls: without a score of 0, instances of no trusted pattern would be confident
        salted = trusted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        support = edges.withColumn("salt", F.expr(f"cast(pmod(xxhash64(instance), {SALTS}) as int)")).join(salted, ["kind", "pattern", "salt"], "left").groupBy("kind", "instance").agg(F.max("seed").alias("seed"), F.sum(F.log1p(-F.least(F.coalesce("score", F.lit(0.0)), F.lit(0.999)))).alias("miss"))
        confidence = F.when(F.col("seed"), 1.0).otherwise(1 - F.exp("miss"))
        instances = materialise(support.select("kind", "instance", confidence.alias("confidence")), "instances")
    return trusted, instances.where(F.col("confidence") >= LEAST_INSTANCE)


def personal_data(docs: DataFrame) -> DataFrame:
    """(row_key, doc_id, base, found, seeded): base spans, those that patterns add, and those of the added ones that are seeds; spans are (kind, start, end), kind an index into KINDS.

    docs: row_key, doc_id, text, as ``row_keyed`` gives them.
    """
    scanned, new = _bootstrapped(docs, 0)
    span = F.struct("kind", "start", "end")
    found = new.groupBy("row_key").agg(F.sort_array(F.collect_set(span)).alias("found"), F.sort_array(F.collect_set(F.when(F.col("seed"), span))).alias("seeded"))
    none = F.expr(f"cast(array() as {_SPAN_SQL})")
    return scanned.join(found, "row_key", "left").select("row_key", "doc_id", F.col("spans").alias("base"), F.coalesce("found", none).alias("found"), F.coalesce("seeded", none).alias("seeded"))


def _bootstrapped(docs: DataFrame, hide: int) -> tuple[DataFrame, DataFrame]:
    """(scanned texts; mentions that patterns add: row_key, kind, start, end, seed, hidden, a row for each trusted pattern)."""
    ship(docs.sparkSession)
    scanned = materialise(docs.select("row_key", "doc_id", "text").mapInArrow(_scan(hide), _SCAN_SQL), "scanned")
    mentions = scanned.select("row_key", F.inline("mentions")).select("row_key", "kind", "start", "end", "instance", "seed", "hidden", F.explode("patterns").alias("pattern"))
    edges = materialise(mentions.groupBy("kind", "pattern", "instance").agg(F.max("seed").alias("seed")), "edges")
    trusted, confident = score_patterns(edges)
    new = mentions.where(f"not seed or kind = {SECRET}").join(trusted.select("kind", "pattern"), ["kind", "pattern"], "left_semi").join(confident.select("kind", "instance"), ["kind", "instance"], "left_semi")
    return scanned, new.select("row_key", "kind", "start", "end", "seed", "hidden")


def discovery(docs: DataFrame, hide: int = 2) -> DataFrame:
    """One row (hidden, back, discovered): mentions of secrets hidden from the bootstrap, how many of them it finds, and all that it finds beyond its seeds.

    Recall is back / hidden, precision back / discovered, where the hidden are all that is known to be true.
    """
    scanned, new = _bootstrapped(docs, hide)
    hidden = scanned.select(F.inline("mentions")).agg(F.count_if("hidden").alias("hidden"))
    once = new.where("not seed").dropDuplicates(["row_key", "kind", "start", "end"])
    return hidden.crossJoin(once.agg(F.count_if("hidden").alias("back"), F.count("*").alias("discovered")))  # one row each


def redact(text: str | None, spans: list[dict]) -> str | None:
    """The text with each stretch of spans replaced by <KIND> of its first."""
    if not spans or text is None:
        return text
    out, at = [], 0
    for a, b, kind in sorted((s["start"], s["end"], s["kind"]) for s in spans):
        if a >= at:
            out += [text[at:a], f"<{KINDS[kind].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redacted(documents: DataFrame) -> DataFrame:
    """The documents with their personal data replaced; n_chars, where there is one, follows the text."""
    whole, key, docs = keyed_table(documents)
    spans = personal_data(docs).select(F.col("row_key").alias(key), F.concat("base", "found").alias("spans")).where("size(spans) > 0")
    mark = fresh_name(whole, "spans")
    marked = whole.join(spans.withColumnRenamed("spans", mark), key, "left").drop(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, j = batch.schema.get_field_index("text"), batch.schema.get_field_index(mark)
            new = [redact(t, s) for t, s in zip(batch.column(i).to_pylist(), batch.column(j).to_pylist(), strict=True)]
            yield batch.set_column(i, batch.schema.field(i), pa.array(new, batch.schema.field(i).type)).remove_column(j)

    out = marked.mapInArrow(run, documents.schema)
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return out


def _joined(spans: str) -> str:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform(array_sort({spans}), s -> concat(element_at(array({names}), s.kind + 1), ':', s.start, ':', s.end)), ',')"


def op3_bootstrapped_pii(spark, sf_dir: str) -> DataFrame:
    out = personal_data(row_keyed(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = {i})) as long)").alias(f"n_{k}") for i, k in enumerate(BASE_KINDS)]
    return out.select("doc_id", *counts, F.sha2(F.expr(_joined("base")), 256).alias("base_sha256"), F.expr(_joined("concat(base, found)")).alias("spans"), (F.size("found") - F.size("seeded")).cast("long").alias("n_found"), F.size("seeded").cast("long").alias("n_seeded"))
