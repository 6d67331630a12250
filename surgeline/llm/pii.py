"""Personal data by bootstrapped contextual extraction.

Four kinds of entity with a fixed form are the seeds. What stands before a seed, or
before any other token that looks like an identifier, is a lexical pattern: the last
two words, or the last word and the symbols after it, as in ``token = "``. Whatever
fills a pattern's place anywhere, ordinary words included, is an instance of it. Over
the graph of patterns and instances, Spark scores in turns: a pattern by the mean
score of its distinct instances, an instance by its best pattern and by the share of
seeds among values with as many digits. Plain words score nothing, so a pattern is
confident only where identifiers alone follow it. Instances of confident patterns are
new identifiers.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surgeline.llm.shared import Scratch, maybe_broadcast, tune, whole_row

KINDS = ("email", "ip", "card", "phone")
#: Turns of scoring; distinct identifier-like instances that a pattern needs; least score of an instance.
ROUNDS, SUPPORT, CONFIDENT = 6, 4, 0.8
#: A pattern counts for its instances from this score on; one with a smaller share of identifier-like instances can't get there.
PURE = 0.3
#: Digits from which a token looks like an identifier, and is found wherever it stands once a pattern gives it away.
DIGITS = 4
#: Characters before an entity in which its pattern must lie.
REACH = 60
#: Patterns that are looked for in one scan; more of them take more scans.
CHUNK = 200_000

_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
# a start inside a run of digits can't match where the run's first digit doesn't
_ip = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+").finditer
# a chain of fewer digits fails its length, so it need not be matched
_card = re.compile(r"[0-9](?:[ -]?[0-9]){13,}").finditer
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]").finditer
_digits = re.compile(r"[0-9]+")
_last = re.compile(r"(?<!\w)([^\W\d]+)(\W+)\Z").search
_edge = ".,;:!?()[]{}<>\"'`*#$%&|=…«»“”"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _local:
            start -= 1
        m = _domain(text, at + 1) if start < at else None
        if m:
            done = m.end()
            out.append((start, done))
        at = text.find("@", max(at + 1, done))
    return out


def base_entities(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the entities with a fixed form, sorted; kind is a position in KINDS."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _digits.search(text):
        if "." in text:
            for m in _ip(text):
                if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m[0].split(".")):
                    out.append((m.start(), 1, m.end()))
        for m in _card(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _phone(text):
                if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def lower(text: str) -> str:
    """Lower case, character by character, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def frames(low: str, start: int) -> list[str]:
    """The patterns of a place in a lower-cased text, with all that stands between their words and it: of two words, and of one with symbols after it. Words have no digits."""
    at = max(low.rfind("\n", 0, start) + 1, start - REACH)
    whole = at == 0 or not (low[at - 1].isalnum() or low[at - 1] == "_")
    left = low[at:start]
    out = []
    m = _last(left)
    if m and (m.start() or whole):
        if not m[2].isspace():
            out.append(left[m.start() :])
        m = _last(left, 0, m.start())
        if m and (m.start() or whole):
            out.append(left[m.start() :])
    return out


def fill(text: str, at: int) -> int:
    """End of the token that starts at a place; the place itself where none does."""
    if at >= len(text) or text[at].isspace() or text[at] in _edge:
        return at
    end = at
    while end < len(text) and not text[end].isspace():
        end += 1
    while text[end - 1] in _edge:
        end -= 1
    return end


def digits_of(value: str) -> int:
    return sum(c in "0123456789" for c in value)


def candidates(text: str, known: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Tokens with DIGITS digits or more that overlap no known entity."""
    out, done = [], 0
    for m in _digits.finditer(text):
        if m.start() < done:
            continue
        a, b = m.start(), m.end()
        while a > done and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        done = b
        while a < b and text[a] in _edge:
            a += 1
        while b > a and text[b - 1] in _edge:
            b -= 1
        if sum(c in "0123456789" for c in text[a:b]) >= DIGITS:
            out.append((a, b))
    return [(a, b) for a, b in out if not any(s < b and a < e for s, _, e in known)] if known else out


def distinct(batch):
    """(th, text) of an Arrow batch's different texts."""
    seen = set()
    for th, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        if text and th not in seen:
            seen.add(th)
            yield th, text


def read(batches):
    """Arrow function: (th, text) to (th, start, end, value, seed, patterns), a row for each entity and each token that looks like an identifier."""
    import pyarrow as pa

    names = ["th", "start", "end", "value", "seed", "patterns"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.list_(pa.string())]
    for batch in batches:
        cols = [[] for _ in names]
        for th, text in distinct(batch):
            known = base_entities(text)
            here = [(a, b, True) for a, _, b in known] + ([(a, b, False) for a, b in candidates(text, known)] if _digits.search(text) else [])
            low = lower(text) if here else ""
            for a, b, seed in here:
                for c, x in zip(cols, (th, a, b, low[a:b], seed, frames(low, a))):
                    c.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)


def places(text: str, automaton, without=frozenset()):
    """(pattern, start, end, value, seed) of whatever fills the place of an automaton's patterns, but for those without."""
    low = lower(text)
    known = None
    for last, pattern in automaton.iter(low) if len(automaton) else ():  # one without patterns can't be asked
        at = last + 1 - len(pattern)
        if pattern in without or at and (low[at - 1].isalnum() or low[at - 1] == "_"):
            continue
        a, b = last + 1, fill(text, last + 1)
        if a == b:
            continue
        if known is None:
            known = base_entities(text)
        seed = next(((s, e) for s, _, e in known if s < b and a < e), None)
        yield (pattern, *(seed or (a, b)), low[slice(*seed)] if seed else low[a:b], seed is not None)


def automaton_of(patterns: list[str]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for p in patterns:
        out.add_word(p, p)
    out.make_automaton()
    return out


def instances(patterns: list[str]):
    """Arrow function: (th, text) to (th, start, end, value, seed, pattern) of whatever fills the patterns' places but plain words."""
    import pyarrow as pa

    names = ["th", "start", "end", "value", "seed", "pattern"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.string()]

    def run(batches):
        automaton = automaton_of(patterns)
        for batch in batches:
            cols = [[] for _ in names]
            for th, text in distinct(batch):
                for pattern, a, b, value, seed in places(text, automaton):
                    if seed or not value.isalpha():
                        for c, x in zip(cols, (th, a, b, value, seed, pattern)):
                            c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return run


def plain_words(most: dict[str, int]):
    """Arrow function: (th, text) to a task's different (pattern, value) of plain words in the patterns' places. A pattern of which the task alone sees more than most has one row, with a null; the task looks for it no longer."""
    import pyarrow as pa

    def run(batches):
        automaton, words, over = automaton_of(list(most)), {}, set()
        for batch in batches:
            for _, text in distinct(batch):
                for pattern, _, _, value, seed in places(text, automaton, over):
                    if not seed and value.isalpha():
                        mine = words.setdefault(pattern, set())
                        mine.add(value)
                        if len(mine) > most[pattern]:
                            over.add(pattern)
                            del words[pattern]
        for pattern, values in [*words.items(), *((p, [None]) for p in over)]:
            yield pa.RecordBatch.from_arrays([pa.array([pattern] * len(values), pa.string()), pa.array(list(values), pa.string())], ["pattern", "value"])

    return run


def bucket(value: Column) -> Column:
    """Values with as many digits, by powers of two."""
    return F.length(F.bin(F.length(F.regexp_replace(value, "[^0-9]", "")).cast("long")))


def plain(value: Column) -> Column:
    """Whether a value is a plain word."""
    return value.rlike(r"^\p{L}+$")


def pure_patterns(edges: DataFrame) -> DataFrame:
    """Of edges (pattern, value, seed), each pair once: the patterns with SUPPORT values that aren't plain words, and a share of these of at least PURE."""
    totals = edges.groupBy("pattern").agg(F.count("*").alias("n"), F.count_if(F.col("seed") | ~plain(F.col("value"))).alias("ids"))
    return totals.where((F.col("ids") >= SUPPORT) & (F.col("ids") >= PURE * F.col("n"))).select("pattern")


def scores(edges: DataFrame, priors: DataFrame, scratch: Scratch) -> DataFrame:
    """(value, score) over the graph of edges (pattern, value, seed), each pair once. priors (bucket, prior): the share of seeds among values of a bucket.

    A seed scores 1 and a plain word 0, always. In each turn a pattern's score is the
    sum of its instances' scores by their number and one, if SUPPORT of them aren't
    plain; another instance's is 1 - (1 - prior) * (1 - the best of its patterns' scores
    from PURE on).
    """
    edges = edges.withColumn("bucket", bucket(F.col("value"))).join(F.broadcast(priors), "bucket", "left")  # as many rows as there are powers of two
    edges = scratch.table(edges.select("pattern", "value", "seed", plain(F.col("value")).alias("plain"), F.coalesce("prior", F.lit(0.0)).alias("prior")))
    start = F.when(F.col("seed"), 1.0).when(F.col("plain"), 0.0).otherwise(F.col("prior"))
    score = edges.select("pattern", "value", "plain", start.alias("score"))
    for turn in range(ROUNDS):
        totals = score.groupBy("pattern").agg(F.sum("score").alias("good"), F.count("*").alias("n"), F.count_if(~F.col("plain")).alias("ids"))
        patterns = scratch.table(totals.where(F.col("ids") >= SUPPORT).select("pattern", (F.col("good") / (F.col("n") + 1)).alias("sure")).where(F.col("sure") >= PURE))
        best = edges.where("not seed and not plain").join(maybe_broadcast(patterns, 200_000), "pattern").groupBy("value").agg(F.max("sure").alias("sure"), F.max("prior").alias("prior"))
        values = scratch.table(best.select("value", (1 - (1 - F.col("prior")) * (1 - F.col("sure"))).alias("score")))
        if turn + 1 < ROUNDS:
            score = edges.join(maybe_broadcast(values.withColumnRenamed("score", "now"), 200_000), "value", "left").select("pattern", "value", "plain", F.when(F.col("seed") | F.col("plain"), start).otherwise(F.coalesce("now", "prior")).alias("score"))
    return values


def discover(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(th, new): of each text with any, the places (start, end) of identifiers that only their context gives away. docs (th, text)."""
    spark = docs.sparkSession
    seen = scratch.table(docs.mapInArrow(read, "th long, start int, end int, value string, seed boolean, patterns array<string>"))
    # each pair of pattern and value counts once, so that copies of a text lend a pattern no weight
    values = seen.groupBy("value").agg(F.max("seed").alias("seed")).withColumn("bucket", bucket(F.col("value")))
    priors = scratch.table(values.groupBy("bucket").agg((F.count_if("seed") / (F.count("*") + 1)).alias("prior")))
    known = seen.select("value", F.explode("patterns").alias("pattern")).distinct().groupBy("pattern").count().where(F.col("count") >= SUPPORT).select("pattern")
    known = scratch.table(known.withColumn("salt", F.xxhash64("pattern")))
    found = edges = None
    parts = -(-known.count() // CHUNK)
    for part in range(parts):  # one, unless there are very many patterns
        patterns = sorted(r[0] for r in known.where(F.pmod("salt", F.lit(parts)) == part).select("pattern").collect())
        here = scratch.table(docs.mapInArrow(instances(patterns), "th long, start int, end int, value string, seed boolean, pattern string"))
        pairs = scratch.table(here.groupBy("pattern", "value").agg(F.max("seed").alias("seed")))
        # plain words that a pattern may have beside so many other values; where more are seen by one task, that settles it
        most = {r.pattern: int(r.ids / PURE) - r.ids for r in pairs.groupBy("pattern").agg(F.count("*").alias("ids")).collect()}
        words = scratch.table(docs.mapInArrow(plain_words(most), "pattern string, value string").distinct())
        over = maybe_broadcast(words.where("value is null").select("pattern"), 200_000)
        pairs = pairs.union(words.where("value is not null").withColumn("seed", F.lit(False))).join(over, "pattern", "left_anti")
        found, edges = (here, pairs) if found is None else (found.union(here), edges.union(pairs))
    if found is None:
        return spark.createDataFrame([], "th long, new array<struct<start:int,end:int>>")
    pure = maybe_broadcast(scratch.table(pure_patterns(edges)), 200_000)
    edges, found = edges.join(pure, "pattern", "left_semi"), found.join(pure, "pattern", "left_semi")
    sure = scratch.table(scores(edges, priors, scratch).where(F.col("score") >= CONFIDENT).select("value"))
    new = found.where("not seed").select("th", "start", "end", "value").union(seen.where("not seed").select("th", "start", "end", "value"))
    new = new.join(maybe_broadcast(sure, 200_000), "value", "left_semi")
    return scratch.table(new.groupBy("th").agg(F.collect_set(F.struct("start", "end")).alias("new")))


def entities_of(text: str, new: list) -> list[tuple[int, int, int, bool]]:
    """(start, kind, end, base) of a text, sorted; of new places that overlap each other the first, and the longest of those, counts."""
    out = [(a, k, b, True) for a, k, b in base_entities(text)]
    known = list(out)
    done = 0
    for x in sorted(new, key=lambda x: (x["start"], -x["end"])):
        if x["start"] >= done and not any(a < x["end"] and x["start"] < b for a, _, b, _ in known):
            out.append((x["start"], len(KINDS), x["end"], False))
            done = x["end"]
    return sorted(out)


def with_context(docs: DataFrame, id_col, text_col: str) -> DataFrame:
    """docs as (id, text, new)."""
    scratch = Scratch(docs.sparkSession, "pii")
    th = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    new = discover(docs.select(th.alias("th"), F.col(text_col).alias("text")), scratch)
    rows = docs.select(id_col.alias("id"), F.col(text_col).alias("text"), th.alias("th"))
    return rows.join(maybe_broadcast(new, 300_000), "th", "left").select("id", "text", "new")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal data in every document: a row for each row of docs, (id, row, entities).

    entities: array of (start, kind, end, base), sorted by start, then kind;
    places in code points, end exclusive. kind numbers email, ip, card, phone and
    (4) context, an identifier that only its context gives away; those overlap no
    entity of the other kinds. A token of DIGITS digits or more is found wherever it
    stands once it is known; another only in a confident pattern's place, and never a
    plain word. row is unique. Null and empty texts have none.
    Repeated rows have equal results. Copies, however they lie among tasks, lend a
    pattern no weight and take none: it is judged by its different values alone. Ties in
    score don't matter, as scores meet thresholds alone. An empty table gives no
    rows. Other columns are not read. Texts are searched whole, however long.
    """
    import pyarrow as pa

    tune(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    entity = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            found = [[dict(zip(("start", "kind", "end", "base"), e)) for e in entities_of(text or "", new or ())] for text, new in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(range(row, row + len(batch)), pa.int64()), pa.array(found, entity)], ["id", "row", "entities"])
            row += len(batch)

    out = with_context(docs, F.col(id_col), text_col).mapInArrow(run, f"id {kind}, row long, entities array<struct<start:int,kind:int,end:int,base:boolean>>")
    return out.withColumnRenamed("id", id_col)


def joined(entities: Column) -> Column:
    """kind:start:end of entities, comma-joined."""
    names = F.array(*[F.lit(k) for k in (*KINDS, "context")])
    return F.array_join(F.transform(entities, lambda e: F.concat_ws(":", F.get(names, e["kind"]), e["start"], e["end"])), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each entity's place in the text taken by its kind in brackets; all columns, and every row, stay. Overlapping entities are one place, named by the first. Null texts stay null."""
    import pyarrow as pa

    tune(docs.sparkSession)
    columns, schema = docs.columns, docs.schema
    at = columns.index(text_col)
    names = (*KINDS, "context")

    def run(batches):
        for batch in batches:
            rows = pa.Table.from_batches([batch]).column("id").combine_chunks().flatten()
            texts = []
            for text, new in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                out, done = [], 0
                for start, kind, end, _ in entities_of(text, new or ()) if text else ():
                    if start >= done:
                        out.append(text[done:start] + f"[{names[kind].upper()}]")
                    done = max(done, end)
                texts.append(None if text is None else "".join(out) + text[done:])
            rows[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(rows, columns)

    # the whole row goes along as the id, so that equal ids don't matter
    return with_context(docs, whole_row(docs), text_col).mapInArrow(run, schema)
