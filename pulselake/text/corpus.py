"""Corpus cleaning, statistics, keyword matching, co-occurrence, term graphs and HTML fields."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pulselake.session import Scratch, small_side
from pulselake.text.vector_index import comparable, distance, nearest

STOP = ["the", "and", "that", "with", "for", "was", "are", "this", "from", "les", "des", "dans", "que", "qui", "der", "die", "das", "und", "los", "las", "para", "con", "del"]


def tokens(text: Column, shortest: int = 3) -> Column:
    """Lower-case words of letters, without tags, digits, punctuation, stop words and short words."""
    plain = F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]*>", " ")), r"[^\p{L}]+", " ")
    return F.filter(F.split(F.trim(plain), " "), lambda w: (F.length(w) >= shortest) & ~w.isin(*STOP))


def slug(text: Column, longest: int = 80) -> Column:
    """ASCII letters and digits joined by hyphens."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, longest)


def _tokens_of(docs: DataFrame) -> Column:
    """The column tokens of docs where it has one, else the tokens of its text."""
    return F.col("tokens") if "tokens" in docs.columns else tokens(F.col("text"))


def token_counts(docs: DataFrame, top: int = 100) -> DataFrame:
    """The most frequent tokens with their counts and document counts (a row of docs is one), ties by token.

    Occurrences and documents are counted in one aggregate on the token, so only counts are shuffled.
    """
    seen = lambda c, n, d: F.transform(c, lambda w: F.struct(w.alias("token"), F.lit(n).alias("n"), F.lit(d).alias("docs")))
    held = docs.select(_tokens_of(docs).alias("t"))
    each = held.select(F.explode(F.concat(seen("t", 1, 0), seen(F.array_distinct("t"), 0, 1))).alias("w")).select("w.*")
    counted = each.groupBy("token").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return counted.orderBy(F.desc("n"), "token").limit(top)


def top_tokens(docs: DataFrame, by: str, top: int = 100) -> DataFrame:
    """(by, token, n): the most frequent tokens of each value of a column, ties by token; null values are left out."""
    each = docs.where(F.col(by).isNotNull()).select(by, F.explode(_tokens_of(docs)).alias("token")).groupBy(by, "token").agg(F.count("*").alias("n"))
    nth = F.row_number().over(W.partitionBy(by).orderBy(F.desc("n"), "token"))
    return each.withColumn("nth", nth).where(F.col("nth") <= top).drop("nth")


def keyword_matches(docs: DataFrame, terms: list[str]) -> Column:
    """Terms contained in the lower-case text."""
    low = F.lower(F.coalesce(F.col("text"), F.lit("")))
    return F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(low, t))


def relevant(docs: DataFrame, terms: list[str]) -> DataFrame:
    """Documents that contain any of the terms."""
    low = F.lower(F.coalesce(F.col("text"), F.lit("")))
    return docs.where(reduce(lambda a, b: a | b, (low.contains(t) for t in terms)))


def keyword_scores(docs: DataFrame, terms: list[str], top: int = 10) -> DataFrame:
    """Documents per term relative to the most frequent one; the top terms, ties by term."""
    hits = docs.select(F.explode(keyword_matches(docs, terms)).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    most = hits.agg(F.max("n").alias("most"))
    return hits.join(F.broadcast(most)).select("term", "n", F.round(F.col("n") / F.col("most"), 4).alias("score")).orderBy(F.desc("score"), "term").limit(top)


def cooccurrence(docs: DataFrame, vocabulary: DataFrame, least: int = 2) -> DataFrame:
    """Pairs a < b of vocabulary tokens that share documents, with the number of these.

    The vocabulary (token) is a bounded top-n list, broadcast as one array; a row of docs is a document
    and emits the pairs of at most that many tokens, so nothing is shuffled but the pairs' counts.
    """
    known = vocabulary.agg(F.collect_list("token").alias("v"))
    held = docs.select(_tokens_of(docs).alias("t")).crossJoin(F.broadcast(known))
    sets = held.select(F.sort_array(F.array_intersect("t", "v")).alias("t"))
    pairs = sets.select(F.explode("t").alias("a"), "t").select("a", F.explode(F.filter("t", lambda b: b > F.col("a"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def all_pairs(docs: DataFrame, least: int = 2, piece: int = 64) -> DataFrame:
    """Pairs a < b of all tokens that share rows of docs, with the number of these; no token is left out.

    A row's sorted distinct tokens are cut into pieces, each dealt out with the tokens from its start on,
    so that a long text's pairs are made by many tasks.
    """
    sets = docs.select(F.monotonically_increasing_id().alias("row"), F.sort_array(F.array_distinct(tokens(F.col("text")))).alias("t")).where(F.size("t") > 1)
    cut = sets.select("row", F.explode(F.sequence(F.lit(1), F.size("t") - 1, F.lit(piece))).alias("lo"), "t").select("row", "lo", F.slice("t", F.col("lo"), F.size("t")).alias("t"))
    dealt = cut.repartition("row", "lo")
    firsts = dealt.select(F.posexplode(F.slice("t", 1, piece)).alias("k", "a"), "t")
    pairs = firsts.select("a", F.explode(F.slice("t", F.col("k") + 2, F.size("t"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def strongest(edges: DataFrame, top: int = 3) -> DataFrame:
    """Each term's strongest partners (term, partner, n, nth), ties by partner; edges count for both of their ends."""
    both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("term"), F.col("b").alias("partner")), F.struct(F.col("b").alias("term"), F.col("a").alias("partner")))).alias("e"), "n").select("e.*", "n")
    return both.withColumn("nth", F.row_number().over(W.partitionBy("term").orderBy(F.desc("n"), "partner"))).where(F.col("nth") <= top)


#: Ids of rows that a task of strongest_partners holds at a time; pairs (with repeats) that it counts if the rows are more than that.
HELD_IDS, TASK_PAIRS = 3 << 26, 1 << 26
#: Most frequent terms, whose partners are counted first; sizes of vocabulary, halved each time, by which rows can be cut; numbers in a row of names.
FIRST_TERMS, CUTS, NAMES = 64, 16, 1 << 16


def _as_bytes(n_terms: int, n_cuts: int):
    """Lists of ids as little-endian bytes, sorted, each with its number of ids below every size of vocabulary."""
    limits = np.array([-(-n_terms >> k) for k in range(n_cuts)], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column("ids")
            ends = col.offsets.to_numpy()
            flat, ends = col.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]], (ends - ends[0]).astype(np.int64)
            row = np.repeat(np.arange(len(col)), np.diff(ends))
            keyed = np.sort(row * (n_terms + 1) + flat)
            cut = np.searchsorted(keyed, np.arange(len(col))[:, None] * (n_terms + 1) + limits) - ends[:-1, None]
            binary = lambda at, values: pa.BinaryArray.from_buffers(pa.binary(), len(col), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values, "<i4"))])
            yield pa.RecordBatch.from_arrays([binary(ends * 4, keyed - row * (n_terms + 1)), binary(np.arange(len(col) + 1) * 4 * n_cuts, cut)], ["ids", "cuts"])

    return run


def _names_as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of names as little-endian bytes."""
    for batch in batches:
        packed = [np.asarray(v.values, "<i4").tobytes() for v in batch.column("ids")]
        yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), batch.column("first")], ["ids", "first"])


def _numbered(df: DataFrame, work: Scratch, name: str, *order: Column) -> DataFrame:
    """df with name, its rows' numbers from 0 in an order."""
    ranged = work.write(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "ranged")
    before = ranged.groupBy("part").count().withColumn("start", F.sum("count").over(W.orderBy("part")) - F.col("count"))  # a row a part
    nth = F.row_number().over(W.partitionBy("part").orderBy(*order))
    out = work.write(ranged.withColumn("nth", nth).join(F.broadcast(before.select("part", "start")), "part").select(*df.columns, (F.col("start") + F.col("nth") - 1).cast("int").alias(name)), name)
    work.drop(ranged)
    return out


def _term_ids(docs: DataFrame, least: int, work: Scratch) -> tuple[DataFrame, DataFrame, int]:
    """The terms of at least so many rows, numbered by falling frequency (token, df, name, id; name numbers them alphabetically), each row's term numbers (ids and cuts, of four bytes each), and the number of terms."""
    sets = docs.select(F.monotonically_increasing_id().alias("row"), F.array_distinct(_tokens_of(docs)).alias("t")).where(F.size("t") > 1)
    sets = work.write(sets, "sets")
    each = sets.select("row", F.explode("t").alias("token"))
    counted = each.groupBy("token").agg(F.count("*").alias("df")).where(F.col("df") >= least)
    terms = _numbered(_numbered(counted, work, "name", F.col("token")), work, "id", F.desc("df"), F.col("name"))
    n_terms = terms.count()
    lists = each.join(terms.select("token", "id"), "token").groupBy("row").agg(F.collect_list("id").alias("ids")).where(F.size("ids") > 1).select("ids")
    rows = work.write(lists.mapInArrow(_as_bytes(n_terms, CUTS), "ids binary, cuts binary"), "ids")  # bytes are copied whole where a list's entries would be one by one
    work.drop(sets)
    return terms, rows, n_terms


def _merged(found: tuple | None, ids: np.ndarray, n: np.ndarray) -> tuple:
    """Counts of ids, added to those found before."""
    if found is None:
        return ids, n
    both, place = np.unique(np.concatenate([found[0], ids]), return_inverse=True)
    return both, np.bincount(place, np.concatenate([found[1], n])).astype(np.int32)


def _counted(ids: np.ndarray, size: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids below size with their counts, those of at least so many."""
    if size <= 8 * len(ids):
        n = np.bincount(ids, minlength=size)
        found = np.flatnonzero(n >= least)
        return found.astype(np.int32), n[found].astype(np.int32)
    ids.sort()
    at = (ids[least - 1 :] == ids[: max(0, len(ids) - least + 1)]).nonzero()[0]  # so many in a row
    at = at[np.diff(ids[at], prepend=-1) != 0]
    return ids[at], (np.searchsorted(ids, ids[at], side="right") - at).astype(np.int32)


def _partners(n_terms: int, n_ids: int, sizes: list, n_blocks: int, top: int, least: int, held: int):
    """Of the terms of one block (numbers equal to it modulo n_blocks): the partners in all rows, in batches (ids, cuts, first, block), where a row with first holds names from that number on.

    sizes: (df, number of terms of at least that df), rising. If all rows are held, a term's partners
    among the most frequent terms are counted first. The top-th of them has a count that a partner must
    reach, and so must the partner's own df, so that only the terms of such df are counted in the term's rows.
    """
    whole, k_first, n_cuts, slice_ = n_ids <= held, min(FIRST_TERMS, n_terms), CUTS, 1 << 22
    limits = np.array([-(-n_terms >> k) for k in range(n_cuts)])
    dfs, above = np.array([d for d, _ in sizes]), np.array([n for _, n in sizes])

    def count(flat: np.ndarray, ends: np.ndarray, cuts: np.ndarray, block: int):
        """(term, least count, partners, counts) of the block's terms over the rows held."""
        pieces = [(a, flat[a : a + slice_]) for a in range(0, len(flat), slice_)]
        own = np.concatenate([np.flatnonzero(part % n_blocks == block) + a for a, part in pieces])
        own = own[np.argsort(flat[own], kind="stable")]
        terms, row = flat[own], np.searchsorted(ends, own, side="right")
        starts = np.concatenate([[0], ends[:-1]])
        if whole:
            first = np.zeros((len(ends), k_first), np.uint8)
            for a, part in pieces:
                at = np.flatnonzero(part < k_first)
                first[np.searchsorted(ends, at + a, side="right"), part[at]] = 1
        for rows in np.split(np.arange(len(own)), np.flatnonzero(np.diff(terms)) + 1) if len(own) else ():
            t, rows, bound = int(terms[rows[0]]), row[rows], least
            if whole and k_first > top:
                n = np.add.reduce(first[rows], axis=0, dtype=np.int32)
                n[t : t + 1] = 0
                bound = max(least, int(np.partition(n, k_first - top)[k_first - top]))
            at = np.searchsorted(dfs, bound)
            cut = int(np.searchsorted(-limits, -above[at], side="right")) - 1 if at < len(above) else n_cuts - 1
            a = starts[rows]
            with_it = np.concatenate([flat[x:y] for x, y in zip(a.tolist(), (a + cuts[rows, cut]).tolist())])
            yield t, bound, *_counted(with_it, int(limits[cut]), bound if whole else 1)

    def unpacked(col: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """Ends of the lists, from 0, and their numbers."""
        ends = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1] // 4
        return ends - ends[0], np.frombuffer(col.buffers()[2], "<i4")[ends[0] : ends[-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, size, cuts, held_ids, block, found = np.empty(min(n_ids, held), np.int32), [], [], 0, None, {}
        name, out = np.empty(n_terms, np.int32), []

        def keep(t: int, bound: int, other: np.ndarray, n: np.ndarray) -> None:
            at = (n >= bound) & (other != t)
            other, n = other[at], n[at]
            order = (n.astype(np.int64) << 32) - name[other]  # by count, then by name
            best = order.argpartition(len(n) - top)[len(n) - top :] if len(n) > top else np.arange(len(n))
            best = best[order[best].argsort()[::-1]]
            out.extend((t, o, c, k) for k, (o, c) in enumerate(zip(other[best].tolist(), n[best].tolist()), 1))

        def taken():
            return count(flat[:held_ids], np.cumsum(np.concatenate(size)), np.concatenate(cuts), block)

        for batch in batches:
            named = batch.filter(batch.column("first").is_valid())
            for values, start in zip(named.column("ids"), named.column("first").to_pylist()):
                values = np.frombuffer(values.as_buffer(), "<i4")
                name[start : start + len(values)] = values
            batch = batch.filter(batch.column("first").is_null())
            if not batch.num_rows:
                continue
            block = batch.column("block")[0].as_py()
            ends, values = unpacked(batch.column("ids"))
            if held_ids + len(values) > len(flat):
                for t, _, *more in taken() if size else ():
                    found[t] = _merged(found.get(t), *more)
                size, cuts, held_ids = [], [], 0
                flat = flat if len(values) <= len(flat) else np.empty(len(values), np.int32)
            flat[held_ids : held_ids + len(values)] = values
            held_ids += len(values)
            size.append(np.diff(ends))
            cuts.append(unpacked(batch.column("cuts"))[1].reshape(-1, n_cuts).copy())
        if size:
            for t, bound, *more in taken():
                if whole:
                    keep(t, bound, *more)
                else:
                    found[t] = _merged(found.get(t), *more)
        for t, more in found.items():
            keep(t, least, *more)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), (pa.int32(), pa.int32(), pa.int64(), pa.int32()))], ["a", "b", "n", "nth"])

    return run


def strongest_partners(docs: DataFrame, top: int = 3, least: int = 2, work: Scratch | None = None) -> DataFrame:
    """strongest(all_pairs(docs)), exactly, without a shuffle of pairs.

    Terms are dealt into blocks. A task reads all rows, as written term numbers, and counts the
    partners of its block's terms; only the few strongest leave it. So the disk holds the rows' numbers
    alone, and the rows are read once a block: four blocks a core, or blocks of about TASK_PAIRS
    pairs where the rows are more than a task holds and counts have to be kept instead.
    """
    work = work or Scratch(docs.sparkSession, "partners")
    terms, rows, n_terms = _term_ids(docs, least, work)
    lists = terms.groupBy(F.floor(F.col("id") / NAMES).alias("k")).agg(F.sort_array(F.collect_list(F.struct("id", "name"))).alias("l")).select(F.col("l.name").alias("ids"), F.col("l.id")[0].alias("first"))
    names = work.write(lists.mapInArrow(_names_as_bytes, "ids binary, first int").select("ids", F.lit(None).cast("binary").alias("cuts"), "first"), "names")
    n_ids, pairs = rows.select((F.length("ids") / 4).cast("long").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0))).first()
    sizes, n = [], 0
    for df, with_df in terms.groupBy("df").agg(F.count("*")).orderBy(F.desc("df")).collect():  # a row a frequency
        n += with_df
        sizes.insert(0, (df, n))
    n_blocks = max(docs.sparkSession.sparkContext.defaultParallelism * 4, -(-pairs // TASK_PAIRS) if n_ids > HELD_IDS else 0)
    blocks = docs.sparkSession.range(0, n_blocks, 1, n_blocks).select(F.col("id").cast("int").alias("block"))
    given = rows.withColumn("first", F.lit(None).cast("int")).unionByName(names)
    dealt = given.coalesce(1).crossJoin(blocks.hint("shuffle_replicate_nl"))  # a partition is all rows with one block; nothing is shuffled
    best = work.write(dealt.mapInArrow(_partners(n_terms, n_ids, sizes, n_blocks, top, least, HELD_IDS), "a int, b int, n long, nth int"), "best")
    name = lambda k, to: terms.select(F.col("id").alias(k), F.col("token").alias(to))
    return best.join(name("a", "term"), "a").join(name("b", "partner"), "b").select("term", "partner", "n", "nth")


def related_terms(edges: DataFrame, start: str, depth: int = 2, top: int = 20) -> DataFrame:
    """Terms within depth undirected steps of a term, first top by name."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    front = edges.sparkSession.createDataFrame([(start,)], "a string")
    seen = front.select(F.col("a").alias("term"))
    for _ in range(depth):
        front = front.join(both, "a").select(F.col("b").alias("a")).distinct()
        seen = seen.union(front.select(F.col("a").alias("term"))).distinct()
    return seen.where(F.col("term") != start).orderBy("term").limit(top)


def html_fields(pages: DataFrame) -> DataFrame:
    """Title, meta tags, headings and link counts of stored HTML."""
    h = F.coalesce(F.col("html"), F.lit(""))
    one = lambda p: F.nullif(F.trim(F.regexp_extract(h, p, 1)), F.lit(""))
    metas = F.arrays_zip(F.regexp_extract_all(h, F.lit(r'(?i)<meta\s+name="([^"]*)"\s+content="[^"]*"'), F.lit(1)).alias("name"), F.regexp_extract_all(h, F.lit(r'(?i)<meta\s+name="[^"]*"\s+content="([^"]*)"'), F.lit(1)).alias("content"))
    return pages.select("page_id", one(r"(?is)<title[^>]*>([^<]*)</title>").alias("title"), one(r"(?is)<h1[^>]*>([^<]*)</h1>").alias("h1"), F.regexp_count(h, F.lit(r"(?i)<a\s")).cast("long").alias("links"), F.regexp_count(h, F.lit(r"(?i)<p[\s>]")).cast("long").alias("paragraphs"), metas.alias("metas"))


def table_cells(pages: DataFrame, least: int = 1) -> DataFrame:
    """Rows of HTML tables as arrays of cell texts, those with at least so many cells."""
    rows = pages.select("page_id", F.posexplode(F.regexp_extract_all(F.col("html"), F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("nth", "row"))
    cells = F.transform(F.regexp_extract_all("row", F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(c, "<[^>]*>", "")))
    return rows.select("page_id", "nth", cells.alias("cells")).where(F.size("cells") >= least)


def trigrams(text: Column) -> Column:
    """Distinct three-letter pieces."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - 2)), lambda k: F.substring(text, k, F.lit(3))))


def topic_similarity(topic: Column, seeds: Column) -> Column:
    """0.4 Jaccard and 0.6 graded overlap of topic words with seed words.

    Grade of a topic word: 1 if a seed, .5 if one contains the other, .25 if trigrams overlap by more
    than half; summed over the topic's size.
    """
    jaccard = F.size(F.array_intersect(topic, seeds)) / F.greatest(F.size(F.array_union(topic, seeds)), F.lit(1))
    graded = F.aggregate(F.transform(topic, lambda w: word_grade(w, seeds)), F.lit(0.0), lambda a, v: a + v) / F.greatest(F.size(topic), F.lit(1))
    return 0.4 * jaccard + 0.6 * F.least(F.lit(1.0), graded)


def word_grade(w: Column, seeds: Column) -> Column:
    """1 if a seed, .5 if one contains the other, .25 if trigrams overlap by more than half, else 0."""
    part = F.exists(seeds, lambda s: F.contains(s, w) | F.contains(w, s))
    near = F.exists(seeds, lambda s: F.size(F.array_intersect(trigrams(w), trigrams(s))) / F.greatest(F.size(F.array_union(trigrams(w), trigrams(s))), F.lit(1)) > 0.5)
    return F.when(F.array_contains(seeds, w), 1.0).when(part, 0.5).when(near, 0.25).otherwise(0.0)


def text_similarity(docs: DataFrame, seeds: list[str]) -> DataFrame:
    """(doc_id, similarity): topic_similarity of all distinct tokens of each text, every distinct word graded once.

    Words of a grade above 0 are few and join back to the tokens; a row's tokens meet in one sum.
    """
    at = F.array(*map(F.lit, seeds))
    sets = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.array_distinct(tokens(F.col("text"))).alias("t"))
    words = docs.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("token")).distinct()
    work = Scratch(docs.sparkSession, "grades")
    words = work.write(words, "words")  # else the filter on the grade moves below distinct and grades every occurrence
    graded = work.write(words.withColumn("grade", word_grade(F.col("token"), at)).where("grade > 0"), "grades")
    placed = sets.select("doc_id", "row", F.size("t").alias("n"), F.explode_outer("t").alias("token")).join(small_side(graded, graded.count()), "token", "left")
    per = placed.groupBy("row", "doc_id", "n").agg(F.coalesce(F.sum("grade"), F.lit(0.0)).alias("grades"), F.count_if(F.col("grade") == 1.0).alias("same"))
    jaccard = F.col("same") / (F.col("n") + len(set(seeds)) - F.col("same"))
    return per.select("doc_id", (0.4 * jaccard + 0.6 * F.least(F.lit(1.0), F.col("grades") / F.greatest(F.col("n"), F.lit(1)))).alias("similarity"))


def hashed_embedding(docs: DataFrame, dim: int = 384) -> DataFrame:
    """(doc_id, d, v) of the L2-normalised sum of hashed signs of a text's words; zero places are left out."""
    w = docs.select("doc_id", F.explode(tokens(F.col("text"))).alias("t")).groupBy("doc_id", "t").agg(F.count("*").alias("n"))
    placed = w.select("doc_id", F.pmod(F.xxhash64("t"), F.lit(dim)).alias("d"), (F.col("n") * F.when(F.pmod(F.xxhash64("t", F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0)).alias("v"))
    s = placed.groupBy("doc_id", "d").agg(F.sum("v").alias("v")).where("v <> 0")
    return s.withColumn("v", F.col("v") / F.sqrt(F.sum(F.col("v") * F.col("v")).over(W.partitionBy("doc_id"))))


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int = 3) -> DataFrame:
    """The k nearest vectors by L2 distance to each query (query_id, q), ties by vec_id, null distances last.

    Comparable vectors of equal length meet in blocks (`vector_index.nearest`). A pair with another
    vector has the distance that its entries give, mostly null; such vectors and queries are few and broadcast.
    """
    far = lambda v, q: v.crossJoin(F.broadcast(q)).select("query_id", "vec_id", distance("embedding", "q").alias("distance"))
    odd = vectors.where(~comparable("embedding"))
    plain = far(odd, queries).unionByName(far(vectors.where(comparable("embedding")), queries.where(~comparable("q"))))
    scored = nearest(vectors, queries, k).unionByName(plain)
    nth = F.row_number().over(W.partitionBy("query_id").orderBy(F.asc_nulls_last("distance"), "vec_id"))
    return scored.withColumn("nth", nth).where(F.col("nth") <= k)
