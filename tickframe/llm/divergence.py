"""Audit of how far the sources of a language differ in their terms, by sort-based streaming.

Tasks count terms by document, sum them up to (lang, term, source) within a
block of documents and send these partial rows, by (lang, term), to partitions
that are sorted by (lang, term, source, block). A scan of the runs of equal
keys, which holds one run of a term at most, and of it one row a source, gives
document frequencies and counts; terms that are too rare go. A frequent term
has a row for each block and source, however often it occurs, so no run holds
more than the blocks do.

With the totals of all (lang, source) groups a second scan of the same runs
emits partial pairs: for each source of a term's run the difference to every
other source of the language, less what it would be if neither had the term,
summed in the task; sources without the term are counted through the term of
the run, so that its cost follows the rows that are there. Terms of which a
source has more than its language are ranked natively.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickframe.llm import text as T
from tickframe.llm.sharding import numbered
from tickframe.llm.shared import cut

LEAST_DOCUMENTS, TOP = 30, 50
#: Bytes of text that are counted at once.
CHUNK = 4 << 20
#: Partial rows that a task gathers before it hands them on, and groups that a pass over the runs compares with.
ROWS, GROUPS, GROUP_BYTES = 1 << 19, 20_000, 4 << 20
#: Numbers that a task holds at once for partial pairs.
CELLS = 1 << 22
SMOOTH, WHOLE = 5, 1_000_000_000
#: Bytes of ASCII that are no letters.
GAPS = np.ones(256, bool)
GAPS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
RUN = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("df", pa.int64()), ("n", pa.int64())])


def terms(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The terms of all texts, A-Z lower-cased, and the text's number of each; nulls are empty."""
    words = T.words(texts, GAPS)
    size = words.end - words.start
    inside = np.zeros(len(words.data) + 1, np.int8)
    np.add.at(inside, words.start, 1)
    np.add.at(inside, words.end, -1)
    data = T.LOWER[words.data[np.cumsum(inside[:-1], dtype=np.int8) > 0]]
    at = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int64())
    whole = pa.LargeStringArray.from_buffers(len(size), at.buffers()[1], pa.py_buffer(data))
    return whole.dictionary_encode(), words.row


def _runs(batch: pa.RecordBatch, *keys: str) -> np.ndarray:
    """Where the runs of equal keys of a sorted batch begin."""
    new = np.zeros(batch.num_rows, bool)
    new[:1] = True
    for key in keys:
        column = batch.column(key)
        new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def summed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A sorted batch with one row for each run of (lang, term, source)."""
    at = _runs(batch, "lang", "term", "source")
    if len(at) == batch.num_rows:
        return batch
    sums = [pa.array(np.add.reduceat(batch.column(c).to_numpy(), at)) for c in ("df", "n")]
    some = batch.select(["lang", "term", "source"]).take(pa.array(at))
    return pa.RecordBatch.from_arrays([*some.columns, *sums], schema=RUN)


def counted(docs: DataFrame) -> DataFrame:
    """Partial rows (lang, term, source, block, df, n), summed over a block of documents; '' as term marks a group's occurrence."""

    def gathered(parts: list[pa.RecordBatch], block: int) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts)
        total = table.group_by(["lang", "term", "source"]).aggregate([("df", "sum"), ("n", "sum")]).combine_chunks()
        columns = [total.column(c).combine_chunks() for c in ("lang", "term", "source", "df_sum", "n_sum")]
        return pa.RecordBatch.from_arrays([*columns[:3], pa.array(np.full(total.num_rows, block, np.int64)), *columns[3:]], ["lang", "term", "source", "block", "df", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, have, block = [], 0, 0
        for part in T.chunks(batches, size=CHUNK):
            names, row = terms(part.column("text"))
            lang, source = (part.column(c).dictionary_encode() for c in ("lang", "source"))
            group, first, of = np.unique(lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy(), return_index=True, return_inverse=True)
            width = max(1, len(names.dictionary))
            document, times = np.unique(row * width + names.indices.to_numpy(), return_counts=True)
            own, back = np.unique(of[document // width] * width + document % width, return_inverse=True)
            df = np.bincount(back, minlength=len(own)).astype(np.int64)
            n = np.bincount(back, times, len(own)).astype(np.int64)
            at = first[np.concatenate([own // width, np.arange(len(group))])]
            term = pa.concat_arrays([names.dictionary.cast(pa.string()).take(pa.array(own % width)), pa.array([""] * len(group), pa.string())])
            zero = np.zeros(len(group), np.int64)
            columns = [part.column("lang").take(pa.array(at)), term, part.column("source").take(pa.array(at)), pa.array(np.concatenate([df, zero])), pa.array(np.concatenate([n, zero]))]
            parts.append(pa.RecordBatch.from_arrays(columns, schema=RUN))
            have += len(at)
            if have >= ROWS:
                whole = gathered(parts, block)
                parts, have, block = [], 0, block + 1
                yield whole
        if parts:
            yield gathered(parts, block)

    own = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    return own.mapInArrow(run, "lang string, term string, source string, block long, df long, n long")


def runs(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, term, source, n, of_lang, head) of the terms in at least so many documents of their language, in runs.

    of_lang is the term's count in the language, head 1 on a run's first row
    (0 else). The term '' has a row for each (lang, source), with head 0.
    """

    def frequent(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = _runs(batch, "lang", "term")
        size = np.diff(at, append=batch.num_rows)
        df, n = (np.add.reduceat(batch.column(c).to_numpy(), at) for c in ("df", "n"))
        mark = pc.equal(batch.column("term"), "").to_numpy(zero_copy_only=False)
        keep = np.repeat(df >= least, size) | mark
        head = np.zeros(batch.num_rows, np.int32)
        head[at] = 1
        columns = [batch.column("lang"), batch.column("term"), batch.column("source"), batch.column("n"), pa.array(np.repeat(n, size)), pa.array(np.where(mark, 0, head), pa.int32())]
        return pa.RecordBatch.from_arrays(columns, ["lang", "term", "source", "n", "of_lang", "head"]).filter(pa.array(keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in summed_runs(batches):
            yield frequent(whole)

    rows = counted(docs).repartition("lang", "term").sortWithinPartitions("lang", "term", "source", "block")
    return rows.select("lang", "term", "source", "df", "n").mapInArrow(run, "lang string, term string, source string, n long, of_lang long, head int")


def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of rows sorted by (lang, term), cut anew so that no run is parted."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        same = held and all(held[-1].column(c)[-1] == batch.column(c)[0] for c in ("lang", "term"))
        at = int(_runs(batch, "lang", "term")[-1])  # the last run may go on
        if held and (at or not same):
            yield pa.concat_batches([*held, batch.slice(0, at)] if same else held)
            held = []
            if not same and at:
                yield batch.slice(0, at)
        elif at:
            yield batch.slice(0, at)
        held.append(batch.slice(at))
    if held:
        yield pa.concat_batches(held)


def summed_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted partial rows, summed by (lang, term, source) and cut so that no run of (lang, term) is parted; holds a row a source of one run."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = summed(pa.RecordBatch.from_arrays(batch.columns, schema=RUN))
        held = summed(pa.concat_batches([held, batch])) if held is not None else batch
        at = int(_runs(held, "lang", "term")[-1])
        if at:
            yield held.slice(0, at)
            held = held.slice(at)
    if held is not None:
        yield held


def share(count: Column, total: Column) -> Column:
    """1 + floor(WHOLE * count / total) of long numbers by long division, exact while total is under 9e15; 1 if total is 0."""
    rest, out = count, F.lit(0).cast("long")
    for _ in range(3):
        rest = rest * F.lit(1000)
        out = out * F.lit(1000) + F.call_function("div", rest, total)
        rest = F.pmod(rest, total)
    return F.when(total > 0, F.lit(1) + out).otherwise(F.lit(1)).cast("long")


def groups_of(rows: DataFrame) -> DataFrame:
    """(lang, source, total, terms, base, lang_total) of every group: base is its p of a term that it has not."""
    groups = rows.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum("head").alias("head"))
    langs = groups.groupBy("lang").agg(F.sum("head").alias("terms"), F.sum("n").alias("lang_n"))
    more = F.lit(SMOOTH) * F.col("terms")
    out = groups.join(langs, "lang").select("lang", "source", (F.col("n") + more).alias("total"), "terms", (F.col("lang_n") + more).alias("lang_total"))
    return out.withColumn("base", share(F.lit(SMOOTH).cast("long"), F.col("total")))


def partial_pairs(rows: DataFrame, block: list[tuple[str, str, int]]) -> DataFrame:
    """(lang, source, item, extra): over the runs of rows, sums of abs(p - q) less that of the bases, between a source and those of the block.

    rows are (lang, term, source, p, base) in runs; block lists (lang, source,
    base). A pair is met from its first source's rows where both have the
    term, and from either one's where the other has it not.
    """
    of: dict[str, dict[str, int]] = {}
    for lang, source, base in block:
        of.setdefault(lang, {})[source] = base

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], np.ndarray] = {}
        cells = 0

        def emitted() -> Iterator[pa.RecordBatch]:
            for (lang, source), (own, back) in held.items():
                others = list(of[lang])
                for first, second, sums in (([source] * len(others), others, own), (others, [source] * len(others), back)):
                    at = np.flatnonzero(sums)
                    columns = [pa.array([lang] * len(at), pa.string()), pa.array([first[i] for i in at], pa.string()), pa.array([second[i] for i in at], pa.string()), pa.array(sums[at])]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "item", "extra"])

        for batch in runs_of(batches):
            at = _runs(batch, "lang")
            for a, b in zip(at, [*at[1:], batch.num_rows]):
                lang = batch.column("lang")[int(a)].as_py()
                if lang not in of:
                    continue
                for source, own, back in compared(batch.slice(a, b - a), of[lang]):
                    if (lang, source) not in held:
                        held[lang, source] = np.zeros((2, len(own)), np.int64)
                        cells += 2 * len(own)
                    held[lang, source] += (own, back)
                    if cells >= CELLS:
                        yield from emitted()
                        held, cells = {}, 0
        yield from emitted()

    return rows.select("lang", "term", "source", "p", "base").mapInArrow(run, "lang string, source string, item string, extra long")


def compared(part: pa.RecordBatch, others: dict[str, int]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """For sources of whole runs of one language: sums over their rows of what the pair with each of the others has
    over its bases' difference; the second one only of rows whose term the other has not."""
    bases = np.array(list(others.values()), np.int64)
    places = {x: i for i, x in enumerate(others)}
    starts = _runs(part, "term")
    run = np.repeat(np.arange(len(starts)), np.diff(starts, append=part.num_rows))
    codes = part.column("source").dictionary_encode()
    source, names = codes.indices.to_numpy(), codes.dictionary.to_pylist()
    there = np.array([places.get(x, -1) for x in names])[source]
    p, base = part.column("p").to_numpy(), part.column("base").to_numpy()
    step = max(1, CELLS // 8 // max(1, len(bases)))
    for low in range(0, len(starts), step):
        begin, end = starts[low], (starts[low + step] if low + step < len(starts) else part.num_rows)
        q = np.tile(bases, (min(step, len(starts) - low), 1))
        has = np.zeros(q.shape, bool)
        mine = begin + np.flatnonzero(there[begin:end] >= 0)
        q[run[mine] - low, there[mine]] = p[mine]
        has[run[mine] - low, there[mine]] = True
        for a in range(begin, end, step):
            order = a + np.argsort(source[a : min(a + step, end)], kind="stable")
            extra = np.abs(p[order, None] - q[run[order] - low]) - np.abs(base[order, None] - bases)
            alone = np.where(has[run[order] - low], 0, extra)
            first = np.flatnonzero(np.diff(source[order], prepend=-1))
            for k, own, back in zip(source[order][first], np.add.reduceat(extra, first), np.add.reduceat(alone, first)):
                yield names[k], own, back


def audited(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value (long) and rank (int): how each source differs from the others and from its language.

    Part `pair` has a row for each other source of the language with the sum
    of abs(p - q) over all kept terms; part `term` the `top` terms of which
    the source has a greater share than its language, with p - q. p is 1 +
    floor(1e9 (count + 5) / (N + 5 V)). Ranks go by value, then by the bytes of
    the item. Defined cases: null text, lang and source count as ''; a row is
    a document, so repeated rows count each; a text without terms still gives
    its group a place; a language without kept terms has pairs of value 0; an
    empty table has no rows. Other columns are not read, so none can clash.
    The groups are sent to all tasks while they are few (counted first); more
    of them are joined, and compared with in blocks of GROUPS.
    """
    rows = cut(runs(docs, least))
    groups = cut(groups_of(rows))
    n, size = groups.agg(F.count(F.lit(1)), F.sum(F.octet_length("lang") + F.octet_length("source"))).first()
    few = n <= GROUPS and (size or 0) <= GROUP_BYTES
    shares = rows.where("term <> ''").join(F.broadcast(groups) if few else groups, ["lang", "source"])
    smooth = F.lit(SMOOTH)
    shares = shares.select("lang", "term", "source", share(F.col("n") + smooth, F.col("total")).alias("p"), "base", share(F.col("of_lang") + smooth, F.col("lang_total")).alias("q"))
    if few:
        blocks = [groups]
    else:
        shares = cut(shares.repartition("lang", "term").sortWithinPartitions("lang", "term"))
        inside = cut(numbered(groups, ["lang", "source"], "at"))
        blocks = [inside.where(F.col("at").between(a, a + GROUPS - 1)) for a in range(0, n, GROUPS)]
    extra = None
    for block in blocks:
        some = partial_pairs(shares, [(r.lang, r.source, r.base) for r in block.select("lang", "source", "base").collect()])
        extra = some if extra is None else extra.unionByName(some)
    extra = extra.groupBy("lang", "source", "item").agg(F.sum("extra").alias("extra"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("base").alias("other"))
    pairs = groups.join(other, "lang").where("source <> item").join(extra, ["lang", "source", "item"], "left")
    value = F.when(F.col("terms") > 0, F.col("terms") * F.abs(F.col("base") - F.col("other")) + F.coalesce("extra", F.lit(0))).otherwise(0)
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")

    def ranked(found: DataFrame, part: str) -> DataFrame:
        found = found.withColumn("rank", F.row_number().over(by))
        return found.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")

    more = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    pairs = pairs.select("lang", "source", "item", value.cast("long").alias("value"))
    return ranked(pairs, "pair").unionByName(ranked(more, "term").where(F.col("rank") <= top))
