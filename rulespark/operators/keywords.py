"""A keyword index: which rows hold a term anywhere in their text, for tables of terms.

Rows are posted under the tokens of their text, runs of letters and digits in lower case. A term's
longest such run lies within one token wherever the term stands, so the tokens that contain the run list
all rows that may hold the term. Those tokens come from the vocabulary, by the rarest of the run's
q-grams. If the term is that run and nothing else, the lists are the answer; else the listed rows' texts
are read.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rulespark.plans.search import blob
from rulespark.schema import KEYWORD_STOPS

TOKEN = r"([\p{L}\p{N}]+)"
#: Runs are looked up by parts of so many characters, shorter runs by themselves.
GRAM = 3
#: Tables of terms are broadcast up to so many rows, else joined by shuffle.
FEW = 400_000
#: Single words are broadcast up to so many.
WORDS = 2_000_000
#: A task holds so many postings at once, or those of one text, and so many cells of a matrix.
POSTS = 1 << 19
CELLS = 1 << 22
#: The row's text as a number: with the key it tells rows apart.
MARK = "_text"


def runs(text: Column) -> Column:
    """Runs of letters and digits, in order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), 1)


def longest(found: Column) -> Column:
    """The longest run, the first of equal ones; blank if there is none."""
    return F.aggregate(found, F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best))


def fragment(term: Column) -> Column:
    return longest(runs(term))


def grams(run: Column, size: int) -> Column:
    """The distinct parts of ``size`` characters."""
    starts = F.when(F.length(run) >= size, F.sequence(F.lit(1), F.length(run) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: run.substr(i, F.lit(size))))


def marked(rows: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(key, text, MARK): the rows' texts in lower case, and a number for each text."""
    text = blob(tuple(columns))
    return rows.select(*key, text.alias("text")).withColumn(MARK, F.xxhash64("text"))


def tokens_in(text: Column) -> Column:
    """The distinct tokens of a text, and the blank one."""
    return F.array_distinct(F.concat(F.array(F.lit("")), runs(text)))


def postings(texts: DataFrame, key: Sequence[str]) -> DataFrame:
    """(token, key, MARK), once for each row with a token, as often as the row repeats; every row is also posted under the blank token."""
    return texts.select(F.explode(tokens_in(F.col("text"))).alias("token"), *key, MARK)


def kept(pairs: DataFrame, most: int = FEW) -> DataFrame:
    """The table, made once; up to ``most`` rows it is broadcast, so that postings need not be dealt out to meet it."""
    pairs = pairs.persist()
    return F.broadcast(pairs) if pairs.count() <= most else pairs


def _in_order(b: pa.RecordBatch) -> pa.RecordBatch:
    """(key, mark, tokens) by key, null ones first, and mark; rows of one key and mark once."""
    key = b.column("key")
    nan = pc.fill_null(pc.is_nan(key), False) if pa.types.is_floating(key.type) else pa.nulls(len(key), pa.bool_())
    by = pa.table([key.is_valid(), nan, key, b.column("mark")], names=["there", "nan", "key", "mark"])
    b = b.take(pc.sort_indices(by, sort_keys=[(n, "ascending") for n in by.column_names]))
    code, mark = (b.column(n).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False) for n in ("key", "mark"))
    return b.filter(pa.array(np.concatenate([[True], (np.diff(code) != 0) | (np.diff(mark) != 0)])))


def _turned(b: pa.RecordBatch, part: int, limit: int | None) -> pa.RecordBatch:
    """(part, token, docs) of a batch in order: for each token its rows (row, key, mark), the first ``limit`` of them."""
    lists = b.column("tokens")
    words = lists.flatten().dictionary_encode()
    code, row = words.indices.to_numpy(zero_copy_only=False), pc.list_parent_indices(lists).to_numpy()
    by = np.argsort(code, kind="stable")
    code, row = code[by], row[by]
    n = np.bincount(code, minlength=len(words.dictionary))
    if limit:
        row = row[np.arange(len(code)) - np.repeat(np.cumsum(n) - n, n) < limit]
        n = np.minimum(n, limit)
    at = pa.array(row)
    docs = pa.StructArray.from_arrays([at.cast(pa.int32()), b.column("key").take(at), b.column("mark").take(at)], names=["row", "key", "mark"])
    offsets = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part), pa.int64()), words.dictionary, pa.ListArray.from_arrays(offsets, docs)], names=["part", "token", "docs"])


def listed_tokens(texts: DataFrame, key: str, pattern: str, limit: int | None = None) -> DataFrame:
    """(part, token, docs): the rows (row, key, mark) that hold each token, by parts of a task's texts, where they are read.

    A part has ``POSTS`` postings at most, or one text; its rows are numbered by key and mark, those of one key
    and text are one, and its tokens follow each other. With a limit, a token has the first rows of a part only.
    """

    def run(batches):
        part = 0
        for b in batches:
            ends = np.cumsum(pc.list_value_length(b.column("tokens")).to_numpy(zero_copy_only=False))
            lo = 0
            while lo < b.num_rows:
                most = (ends[lo - 1] if lo else 0) + POSTS
                hi = max(lo + 1, int(np.searchsorted(ends, most, side="right")))
                yield _turned(_in_order(b.slice(lo, hi - lo)), part, limit)
                lo, part = hi, part + 1

    kind = texts.schema[key].dataType.simpleString()
    found = texts.select(F.col(key).alias("key"), F.col(MARK).alias("mark"), F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(pattern), 1)).alias("tokens"))
    return found.filter("size(tokens) > 0").mapInArrow(run, f"part long, token string, docs array<struct<row:int,key:{kind},mark:long>>")


def with_parts(tokens: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """Each row with every part of its token that has one of the lengths, as ``term``."""
    sized = tokens.withColumn("_size", F.explode(F.array(*[F.lit(n) for n in lengths]))).filter(F.length("token") >= F.col("_size"))
    placed = sized.withColumn("_from", F.explode(F.sequence(F.lit(1), F.length("token") - F.col("_size") + 1)))
    return placed.withColumn("term", F.col("token").substr(F.col("_from"), F.col("_size"))).drop("token", "_size", "_from")


def lengths_of(terms: DataFrame) -> list[int]:
    return sorted(r.n for r in terms.select(F.length("term").alias("n")).distinct().collect())


def first_holders(words: DataFrame, texts: DataFrame, key: str, limit: int) -> DataFrame:
    """(term, key, MARK): the first ``limit`` rows, and more, of each of ``words`` (term, runs of letters and digits in lower case), by key and MARK.

    A word's first rows are among the first of the tokens that contain it, and a token's among the first of
    each part of the texts; no others are dealt out. Those of all tokens are cut into parts, which meet the words.
    """
    words = kept(words.select("term").distinct(), WORDS)
    lengths = lengths_of(words)
    if not lengths:
        return texts.select(F.lit("").alias("term"), key, MARK).limit(0)
    parts = listed_tokens(texts, key, rf"([\p{{L}}\p{{N}}]{{{lengths[0]},}})", limit)
    each = parts.select(F.col("token").alias("id"), F.explode("docs").alias("d")).select("id", F.col("d.key").alias(key), F.col("d.mark").alias(MARK))
    first = best_of(each, [F.asc_nulls_first(key), F.col(MARK)], limit, 1).select(F.col("id").alias("token"), key, MARK)
    return with_parts(first, lengths).join(words, "term").select("term", key, MARK)


def like_holders(terms: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """(term, key, MARK) of every row whose text is LIKE a term of ``terms`` (term), where the texts are read.

    A term's longest run of letters and digits is part of a token of every such text; a term without one has
    every text read.
    """
    asked = terms.select("term").distinct().withColumn("fragment", fragment(F.col("term")))
    like = F.like(F.col("text"), F.concat(F.lit("%"), "like", F.lit("%")))
    named = kept(asked.filter("fragment <> ''").select(F.col("fragment").alias("term"), F.col("term").alias("like")))
    blank = kept(asked.filter("fragment = ''").select(F.col("term").alias("like")))
    found = texts.crossJoin(blank).filter(like)
    if lengths := lengths_of(named):
        tokens = texts.select("text", key, MARK, F.explode(F.array_distinct(runs(F.col("text")))).alias("token"))
        found = with_parts(tokens, lengths).join(named, "term").filter(like).select(*found.columns).union(found)
    return found.select(F.col("like").alias("term"), key, MARK)


def best_in_parts(rows: DataFrame, asked: pa.Table, kind: str, key: str, key_kind: str, limit: int) -> DataFrame:
    """(id, key, MARK, score): of each part of ``rows`` (part, nth, docs) the best rows of each id, ties by key and MARK.

    ``asked`` (id, nth, n) says how much a row that holds the nth term counts for an id. The rows of a part
    follow each other in one task; ids, and rows if need be, are taken in blocks, so that a matrix has
    ``CELLS`` cells or little more.
    """
    encoded = asked["id"].combine_chunks().dictionary_encode("encode")
    ids, item = encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False)
    nth, n = asked["nth"].to_numpy(), asked["n"].to_numpy()
    by = np.argsort(item, kind="stable")
    shared = rows.sparkSession.sparkContext.broadcast((ids, item[by], nth[by], n[by]))  # FEW rows at most

    def best(held):
        ids, item, nth, n = shared.value
        docs = pa.concat_arrays([b.column("docs").flatten() for b in held])
        term = np.concatenate([np.repeat(b.column("nth").to_numpy(), pc.list_value_length(b.column("docs")).to_numpy()) for b in held])
        place, at, row = np.unique(docs.field("row").to_numpy(), return_index=True, return_inverse=True)
        out = []
        for lo in range(0, len(ids), 256):
            own = slice(*np.searchsorted(item, [lo, lo + 256]))
            terms, column = np.unique(nth[own], return_inverse=True)
            weights = np.zeros((min(256, len(ids) - lo), len(terms)))
            weights[item[own] - lo, column] = n[own]
            here = np.minimum(np.searchsorted(terms, term), len(terms) - 1)
            step = max(1, CELLS // len(terms))
            for start in range(0, len(place), step):
                mine = (terms[here] == term) & (row >= start) & (row < start + step)
                holds = np.zeros((len(terms), min(step, len(place) - start)))
                holds[here[mine], row[mine] - start] = 1
                scores = weights @ holds
                # rows are numbered by key and mark, so a stable order leaves ties to the first
                top = np.argsort(-scores, axis=1, kind="stable")[:, :limit]
                which, rank = np.nonzero(np.take_along_axis(scores, top, 1) > 0)
                out.append((which + lo, at[top[which, rank] + start], scores[which, top[which, rank]]))
        which, at, score = (np.concatenate(c) for c in zip(*out, strict=True))
        found = docs.take(pa.array(at))
        return pa.RecordBatch.from_arrays([ids.take(pa.array(which)), found.field("key"), found.field("mark"), pa.array(score.astype("int64"))], names=["id", key, MARK, "score"])

    def run(batches):
        held, part = [], None
        for b in batches:
            parts = b.column("part").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if held and parts[lo] != part:
                    yield best(held)
                    held = []
                part = parts[lo]
                held.append(b.slice(lo, hi - lo))
        if held:
            yield best(held)

    return rows.select("part", "nth", "docs").mapInArrow(run, f"id {kind}, `{key}` {key_kind}, {MARK} long, score long")


def tokens_of(fragments: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(fragment, token) for every token of the vocabulary that contains a fragment; a blank fragment has the blank token."""
    wanted = fragments.select("fragment").distinct()
    posted = vocabulary.select("token").distinct().filter("token <> ''").select("token", F.explode(F.array_distinct(F.flatten(F.array(*[grams(F.col("token"), n) for n in range(1, GRAM + 1)])))).alias("gram"))
    parts = F.when(F.length("fragment") < GRAM, F.array("fragment")).otherwise(grams(F.col("fragment"), GRAM))
    asked = wanted.filter("fragment <> ''").select("fragment", F.explode(parts).alias("gram"))
    counts = posted.join(asked.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    rarest = asked.join(counts, "gram", "left").groupBy("fragment").agg(F.min_by("gram", F.coalesce("n", F.lit(0))).alias("gram"))
    found = rarest.join(posted, "gram").filter(F.contains("token", "fragment")).select("fragment", "token")
    return found.union(wanted.filter("fragment = ''").select("fragment", F.col("fragment").alias("token")))


def same_row(a: DataFrame, b: DataFrame, key: Sequence[str]) -> Column:
    return reduce(and_, [a[c].eqNullSafe(b[c]) for c in (*key, MARK)])


def holders(terms: DataFrame, posts: DataFrame, texts: DataFrame, key: Sequence[str], wildcards: bool = False, pairs: DataFrame | None = None) -> DataFrame:
    """(term, key, MARK) of every row whose text holds a term of ``terms`` (term, in lower case), rows of one key and text once.

    With ``wildcards``, ``_`` and ``%`` match as in LIKE. Null terms are held by nothing, a blank one
    by every row. A term without letters and digits has every row's text read.
    """
    asked = terms.select("term").filter("term is not null").distinct().withColumn("fragment", fragment(F.col("term")))
    pairs = kept(tokens_of(asked, posts)) if pairs is None else pairs
    wanted = kept(asked.join(pairs, "fragment").select("term", "token", (F.col("term") == F.col("fragment")).alias("sure")))
    listed = posts.join(wanted, "token").select("term", *key, MARK, "sure").distinct()
    unsure = listed.filter(~F.col("sure"))
    names = {c: f"_{i}" for i, c in enumerate((*key, MARK))}
    there = texts.select("text", *[F.col(c).alias(n) for c, n in names.items()]).distinct()
    holds = F.like(F.col("text"), F.concat(F.lit("%"), "term", F.lit("%"))) if wildcards else F.contains("text", "term")
    read = unsure.join(there, reduce(and_, [unsure[c].eqNullSafe(there[n]) for c, n in names.items()])).filter(holds)
    return listed.filter("sure").drop("sure").union(read.select("term", *key, MARK))


def words_asked(questions: DataFrame, id_col: str, text_col: str, limit: int | None = 6) -> DataFrame:
    """(id, term): the first ``limit`` keywords of each question, as ``spec.keywords`` has them; repeats stay."""
    found = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit("([a-z0-9_]+)"), 1)
    kept = F.filter(found, lambda w: (F.length(w) >= 4) & ~w.isin(*sorted(KEYWORD_STOPS)))
    return questions.select(F.col(id_col).alias("id"), F.explode(F.slice(kept, 1, limit) if limit else kept).alias("term"))


def tokens_asked(questions: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, n): the tokens of four characters or more of each question, and how often they stand there."""
    found = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit("([a-z0-9_]+)"), 1)
    return questions.select(F.col(id_col).alias("id"), F.explode(F.filter(found, lambda w: F.length(w) >= 4)).alias("term")).groupBy("id", "term").agg(F.count("*").alias("n"))


def best_of(found: DataFrame, by: list[Column], k: int, shares: int = 32) -> DataFrame:
    """The first ``k`` rows of each id with their ``rank``: in shares first, so that no task sorts a hot id alone.

    With one share equal rows, told apart by nothing in ``by``, are one, and each task's first rows are dealt out once.
    """
    if shares == 1:
        return found.withColumn("rank", F.dense_rank().over(Window.partitionBy("id").orderBy(*by))).filter(F.col("rank") <= k).distinct()
    share = found.withColumn("_share", F.pmod(F.xxhash64(*[c for c in found.columns if c != "id"]), F.lit(shares)))
    some = share.withColumn("rank", F.row_number().over(Window.partitionBy("id", "_share").orderBy(*by))).filter(F.col("rank") <= k).drop("_share")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(*by))).filter(F.col("rank") <= k)


def fallback(rows: DataFrame, questions: DataFrame, key: str, columns: Sequence[str], id_col: str, text_col: str, limit: int = 20, index: KeywordIndex | None = None) -> DataFrame:
    """(id, rank, key): for each question the first ``limit`` rows by key that hold one of its keywords.

    The same rows as ``search.keyword_fallback`` for each question alone. Questions without keywords
    and rows without text give nothing; rows that repeat are found each. Null keys come first.
    """
    asked = words_asked(questions, id_col, text_col).distinct()
    texts = marked(rows, [key], columns)
    order = [F.asc_nulls_first(key), F.col(MARK)]
    if index:
        held = index.holders(asked, texts, wildcards=True)
    else:
        # the underscore is a wildcard: words with one are looked up in the texts
        plain = asked.filter(~F.contains("term", F.lit("_")))
        held, rest = first_holders(plain, texts, key, limit), asked.filter(F.contains("term", F.lit("_")))
        if not rest.isEmpty():
            held = held.union(like_holders(rest, texts, key))
    # a question's first rows are among the first of its terms; a term's other rows meet no question
    first = best_of(held.withColumnRenamed("term", "id"), order, limit, 1 if index is None else 32)
    many = texts.groupBy(F.col(key).alias("_key"), F.col(MARK).alias("_mark")).agg(F.count("*").alias("n")).filter("n > 1")
    told = first.join(many, first[key].eqNullSafe(many["_key"]) & (first[MARK] == many["_mark"]), "left")
    lists = told.groupBy(F.col("id").alias("term")).agg(F.collect_list(F.struct(F.col(key).alias("key"), F.col(MARK).alias("mark"), F.least(F.coalesce("n", F.lit(1)), F.lit(limit)).cast("int").alias("n"))).alias("docs"))
    # a question meets its terms' lists once, and its rows are ranked in the list
    hits = asked.join(lists, "term").groupBy("id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("docs")))).alias("docs"))
    copies = F.slice(F.flatten(F.transform(F.slice("docs", 1, limit), lambda d: F.array_repeat(d["key"], d["n"]))), 1, limit)
    return hits.select("id", F.posexplode(copies).alias("rank", key)).select("id", (F.col("rank") + 1).alias("rank"), key)


def overlap(rows: DataFrame, questions: DataFrame, key: str, columns: Sequence[str], id_col: str, text_col: str, limit: int = 10, index: KeywordIndex | None = None) -> DataFrame:
    """(id, rank, key, score): for each question the rows that hold most of its tokens, as ``search.overlap_topk``; ties by key.

    Rows of one key and text count once; those of one key with different texts each.
    """
    asked = kept(tokens_asked(questions, id_col, text_col))
    texts = marked(rows, [key], columns)
    order = [F.desc("score"), F.asc_nulls_first(key), F.col(MARK)]
    if index is None and (every := asked.limit(FEW + 1).toArrow()).num_rows <= FEW:
        terms = every["term"].combine_chunks().dictionary_encode()
        nth = terms.indices.cast(pa.int64())
        words = rows.sparkSession.createDataFrame(pa.table({"term": terms.dictionary, "nth": np.arange(len(terms.dictionary))}), "term string, nth long")
        # a term is letters, digits and underscores, so it stands in a run of those
        lengths = lengths_of(words) or [1]
        parts = listed_tokens(texts, key, rf"([\p{{L}}\p{{N}}_]{{{lengths[0]},}})")
        # both are where the texts are read: the words are broadcast, and the order of the parts stays
        met = with_parts(parts, lengths).join(F.broadcast(words), "term")
        kinds = [d.schema[c].dataType.simpleString() for d, c in ((asked, "id"), (texts, key))]
        best = best_in_parts(met, pa.table({"id": every["id"], "nth": nth, "n": every["n"]}), kinds[0], key, kinds[1], limit)
        return best_of(best.distinct(), order, limit).select("id", "rank", key, "score")
    held = index.holders(asked, texts) if index else holders(asked, postings(texts, [key]), texts, [key])
    # the terms of a row meet in one task: there they are joined to the questions and summed, and only the best are dealt out
    scored = held.repartition(key, MARK).join(asked, "term").groupBy("id", key, MARK).agg(F.sum("n").alias("score"))
    return best_of(scored, order, limit).select("id", "rank", key, "score")


def contains_join(rows: DataFrame, id_col: str, text_col: str, items: DataFrame, item_col: str, item_text: str) -> DataFrame:
    """(id, item id) for every row and every item that stands in its text, letter by letter.

    Rows and items that repeat are joined each; null ids stay null; null texts hold nothing and null
    items stand nowhere, a blank item in every text. An item is looked up by a run of letters and digits
    that does not touch its ends, which is a whole token of every text that holds the item, or else by
    its longest run, which is part of one.
    """
    texts = rows.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).filter("text is not null").withColumn(MARK, F.xxhash64("text"))
    asked = items.select(F.col(item_col).alias("_item"), F.col(item_text).cast("string").alias("needle")).filter("needle is not null")
    inner = longest(F.regexp_extract_all("needle", F.lit(r"(?<=[^\p{L}\p{N}])([\p{L}\p{N}]+)(?=[^\p{L}\p{N}])"), 1))
    needles = asked.select("needle").distinct().withColumn("inner", inner).withColumn("fragment", fragment(F.col("needle")))
    posts = postings(texts, ["_id"])
    whole = needles.filter("inner <> ''").select("needle", F.col("inner").alias("token"))
    edged = needles.filter("inner = ''")
    tokens = kept(whole if edged.isEmpty() else whole.union(edged.join(tokens_of(edged, posts), "fragment").select("needle", "token")))
    if tokens.count() <= FEW:
        # the text stays beside its tokens, so neither is dealt out
        each = texts.select("_id", "text", F.monotonically_increasing_id().alias("_row"), F.explode(tokens_in(F.col("text"))).alias("token"))
        held = each.join(tokens, "token").filter(F.contains("text", "needle")).select("_row", "_id", "needle").distinct()
    else:
        listed = posts.join(tokens, "token").select("needle", F.col("_id").alias("_of"), F.col(MARK).alias("_mark")).distinct()
        held = texts.join(listed, F.col("_id").eqNullSafe(F.col("_of")) & (F.col(MARK) == F.col("_mark"))).filter(F.contains("text", "needle"))
    return held.select("_id", "needle").join(asked, "needle").select(F.col("_id").alias(id_col), F.col("_item").alias(item_col))


class KeywordIndex:
    """Postings in a folder, kept by batch and by bucket of the token.

    ``add`` writes a batch's postings and vocabulary, and replaces those of a batch of the same name;
    other batches are not read. A search reads the vocabulary, and of the postings only the buckets of
    the tokens that list something.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("token"), F.lit(self.buckets)).cast("int")

    def add(self, batch: str, rows: DataFrame, columns: Sequence[str]) -> None:
        posts = postings(marked(rows, [self.key], columns), [self.key]).distinct().withColumn("batch", F.lit(batch)).withColumn("bucket", self._bucket())
        # the blank token lists every row: such hot tokens are dealt out by row as well
        dealt = posts.repartition("bucket", F.pmod(F.col(MARK), F.lit(8))).sortWithinPartitions("bucket", "token")
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "bucket").parquet(f"{self.path}/postings")
        written = self.spark.read.parquet(f"{self.path}/postings").filter(F.col("batch") == batch)
        written.select("batch", "token").distinct().write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.path}/vocabulary")

    def listed(self, pairs: DataFrame) -> DataFrame:
        """The postings of the buckets in which the tokens of ``pairs`` are."""
        wanted = [r.b for r in pairs.select(self._bucket().alias("b")).distinct().collect()]  # ``buckets`` numbers at most
        # only the folders of those buckets are listed and read; a bucket of a token is there, as its postings are
        read = self.spark.read.option("basePath", f"{self.path}/postings")
        found = read.parquet(*[f"{self.path}/postings/batch=*/bucket={b}" for b in wanted]) if wanted else read.parquet(f"{self.path}/postings").limit(0)
        return found.select("token", self.key, MARK)

    def holders(self, terms: DataFrame, texts: DataFrame, wildcards: bool = False) -> DataFrame:
        """As the function of that name, from the kept postings of all batches."""
        asked = terms.select("term").filter("term is not null").distinct().withColumn("fragment", fragment(F.col("term")))
        pairs = tokens_of(asked, self.spark.read.parquet(f"{self.path}/vocabulary"))
        return holders(terms, self.listed(pairs), texts, [self.key], wildcards, pairs)
