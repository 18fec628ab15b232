"""Mention scoring: terms of titles, their weights, spans in sentences, relevance, and ranks over time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs
from ..functions.tagger import Perceptron, Scorer, Trainer, noun_share, predict
from ..storage import BROADCAST_BYTES, counted_bytes, materialise

EARLY = (5.0, 4.0, 2.0, 1.0)
"""Multipliers of a disambiguation page's first four destinations."""

SALTS = 32
"""Groups of sentences that look apart for their words' widths."""

PACKED = 4096
"""Sentences of a run in which the tagger's training data pass through the driver."""


def terms(titles: DataFrame) -> DataFrame:
    """``titles(title, node_id)`` -> (term, node_id)."""
    return titles.select(exprs.normalised_term(F.col("title")).alias("term"), "node_id")


def term_weights(terms_: DataFrame, ranks: DataFrame) -> DataFrame:
    """(term, node_id, weight): a term's weight is dealt to its nodes by rank; further rows of the same node get 0.

    Aggregated before it is spread again, so a term of very many rows moves as a few.
    """
    each = terms_.groupBy("term", "node_id").agg(F.count(F.lit(1)).alias("rows")).join(ranks.select("node_id", "value"), "node_id")
    total = each.groupBy("term").agg(F.sum("value").alias("total"))
    spread = each.join(total, "term").withColumn("j", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return spread.select("term", "node_id", F.when(F.col("j") == 1, F.col("value") / F.col("total")).otherwise(0.0).alias("weight"))


def max_span_map(titles: DataFrame) -> DataFrame:
    """(word, width): for each first word of a title, the most words of such a title."""
    words = titles.select(exprs.normalised_words(F.col("title")).alias("w")).where("size(w) > 0")
    return words.groupBy(F.col("w")[0].alias("word")).agg(F.max(F.size("w")).alias("width"))


def disambiguation_shares(edges: DataFrame, ranks: DataFrame, disambiguations: DataFrame) -> DataFrame:
    """(src, dst, share): what a disambiguation page gives to each destination: by rank, and, the more it has, by being among the first four."""
    at = edges.join(disambiguations.select(F.col("node_id").alias("src")), "src", "left_semi").select("src", "dst", "link_idx").distinct()
    at = at.join(ranks.select(F.col("node_id").alias("dst"), "value"), "dst")
    placed = at.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy("link_idx", F.desc("dst"))))
    early = F.when(F.col("r") <= 4, F.col("value") * F.element_at(F.array(*map(F.lit, EARLY)), F.least(F.lit(4), F.col("r")))).otherwise(0.0)
    sums = placed.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("all"), F.sum(early).alias("some"))
    alpha = F.least(F.lit(0.75), F.log2(F.greatest(F.lit(1), F.col("n") - 4)) / 8)
    w1 = F.col("value") / F.col("all")
    w2 = F.when(F.col("n") > 4, early / F.col("some")).otherwise(0.0)
    return placed.join(sums, "src").select("src", "dst", (2.0 * (w1 + alpha * (w2 - w1))).alias("share"))


def hatnote_shares(hat: DataFrame, ranks: DataFrame, disambiguations: DataFrame) -> DataFrame:
    """(src, dst, share): what a page with hatnotes gives to their destinations, and, as dst = src, keeps."""
    bounds = ranks.agg(F.log2(F.min("value")).alias("low"), F.log2(F.avg("value")).alias("mean"))
    sources = hat.select("src").distinct()
    to = hat.join(disambiguations.select(F.col("node_id").alias("dst")), "dst", "left_anti").select("src", "dst")
    raw = to.join(ranks.select(F.col("node_id").alias("dst"), "value"), "dst").crossJoin(F.broadcast(bounds))
    raw = raw.select("src", "dst", ((F.log2("value") - F.col("low")) / (2 * (F.col("mean") - F.col("low")))).alias("v"))
    sums = raw.groupBy("src").agg(F.sum("v").alias("total"))
    given = raw.join(sums, "src").select("src", "dst", (0.66 * F.col("v") / F.greatest(F.lit(1.0), F.col("total"))).alias("share"))
    kept = sources.join(given.groupBy("src").agg(F.sum("share").alias("given")), "src", "left")
    return given.unionByName(kept.select("src", F.col("src").alias("dst"), (2.0 - F.coalesce("given", F.lit(0.0))).alias("share")))


def assigned_weights(weights: DataFrame, ranks: DataFrame, edges: DataFrame, hat: DataFrame, disambiguations: DataFrame) -> DataFrame:
    """(term, node_id, weight): terms of disambiguation pages and of pages with hatnotes go to their destinations too; others count twice their weight."""
    used = weights.where("term <> '' and weight <> 0").select("term", F.col("node_id").alias("src"), "weight")
    disamb = disambiguations.select(F.col("node_id").alias("src")).distinct()
    hatted = hat.select("src").distinct().join(disamb, "src", "left_anti")
    first = used.join(disambiguation_shares(edges, ranks, disambiguations), "src").select("term", F.col("dst").alias("node_id"), F.col("share").alias("weight"))
    second = used.join(hatted, "src", "left_semi").join(hatnote_shares(hat, ranks, disambiguations), "src").select("term", F.col("dst").alias("node_id"), F.col("share").alias("weight"))
    plain = used.join(disamb, "src", "left_anti").join(hatted, "src", "left_anti").select("term", F.col("src").alias("node_id"), (2.0 * F.col("weight")).alias("weight"))
    return first.unionByName(second).unionByName(plain)


def postings(assigned: DataFrame) -> DataFrame:
    """(term, node_id, weight): the largest weight of each pair, as a float."""
    return assigned.groupBy("term", "node_id").agg(F.max(F.col("weight").cast("float")).alias("weight"))


def _reach(words: Iterable[str], widths: dict[str, int]) -> list[int]:
    """For each place the most words of a span that begins there."""
    words = list(words)
    out, end = [], 0
    for at, word in enumerate(words):
        end = max(end, min(at + widths.get(word, 0), len(words)))
        out.append(max(end - at, 0))
    return out


def spans(sentences: DataFrame, span_map: DataFrame, id_: str = "id") -> DataFrame:
    """``sentences(id, words)`` -> (id, pos, width, term) and the sentences' other columns: every span of words that a title could fill.

    A word that begins titles of up to w words opens the w places from it on, each up to where such
    a title would end.  With a map of few bytes each sentence is cut where it is, without a shuffle.
    Else its words look for their widths; as a word may be very frequent, the map's rows are repeated
    for ``SALTS`` groups of sentences, and only places that a span covers come back to their sentence.
    """
    span_map = materialise(span_map.select("word", "width"), "spans")
    if counted_bytes(span_map) <= BROADCAST_BYTES:
        widths = {row["word"]: row["width"] for row in span_map.collect()}

        @F.pandas_udf("array<int>")
        def reach(column: pd.Series) -> pd.Series:
            return pd.Series([None if words is None else _reach(words, widths) for words in column], dtype=object)

        widest = sentences.select("*", F.posexplode(reach("words")).alias("pos", "widest")).where("widest > 0")
        every = widest.select("*", F.explode(F.sequence(F.lit(1), F.col("widest"))).alias("width"))
    else:
        salted = span_map.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64(id_), F.lit(SALTS)).cast("int").alias("salt")
        each = sentences.select(id_, salt, F.size("words").alias("n"), F.posexplode("words").alias("at", "word")).join(salted, ["word", "salt"])
        width = F.least(F.col("width"), F.col("n") - F.col("at"))
        covered = each.select(id_, "at", width.alias("w")).select(id_, "at", "w", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("i"))
        widest = covered.groupBy(id_, (F.col("at") + F.col("i")).alias("pos")).agg(F.max(F.col("w") - F.col("i")).alias("widest"))
        every = widest.join(sentences, id_).select("*", F.explode(F.sequence(F.lit(1), F.col("widest"))).alias("width"))
    others = [c for c in sentences.columns if c not in (id_, "words")]
    return every.select(id_, "pos", "width", F.array_join(F.slice("words", F.col("pos") + 1, F.col("width")), " ").alias("term"), *others)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (words, tags) in order -> for each run of them the different sentences, and for each row which one it is."""
    for batch in batches:
        for start in range(0, batch.num_rows, PACKED):
            part = batch.slice(start, PACKED)
            numbers: dict[tuple, int] = {}
            codes = [numbers.setdefault((tuple(w), tuple(t)), len(numbers)) for w, t in zip(part["words"].to_pylist(), part["tags"].to_pylist())]
            columns = [pa.array([list(map(list, column))], kind) for column, kind in zip(zip(*numbers), (pa.list_(pa.list_(pa.string())), pa.list_(pa.list_(pa.int32()))))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([np.array(codes, np.int32).tobytes()], pa.binary())], names=["words", "tags", "codes"])


def train_tagger(sentences: DataFrame, order: str) -> tuple[Perceptron, float]:
    """``sentences(words, tags)`` in the order of ``order`` -> model and training accuracy.

    Online training is sequential: sentences pass through the driver in order, in runs whose different sentences come once.
    """
    trainer = Trainer()
    ordered = sentences.orderBy(order).select("words", F.col("tags").cast("array<int>").alias("tags"))
    packed = ordered.mapInArrow(_pack, "words array<array<string>>, tags array<array<int>>, codes binary")
    for row in packed.toLocalIterator(prefetchPartitions=True):
        known = list(zip(row["words"], row["tags"]))
        for code in np.frombuffer(row["codes"], np.int32).tolist():
            trainer.learn(*known[code])
    return trainer.finish()


def tag_words(model: Perceptron):
    """Column function: an array of words -> array of (scores, observations)."""

    @F.pandas_udf("array<struct<scores:array<float>,observations:bigint>>")
    def run(sentences: pd.Series) -> pd.Series:
        return pd.Series([[{"scores": np.array(s, np.float32), "observations": o} for s, o in predict(model, list(w))] for w in sentences], dtype=object)

    return run


def noun_scores(tagged: F.Column, words: F.Column) -> F.Column:
    """Noun score of each word, from (scores, observations)."""
    return F.zip_with(tagged, words, lambda t, w: exprs.noun_score(exprs.softmax(F.transform(t["scores"], lambda s: s.cast("double"))), t["observations"].cast("double"), w))


def word_nouns(model: Perceptron):
    """Column function: an array of words -> array of the words' noun scores, as :func:`noun_scores` of :func:`tag_words` gives them.

    Only a share and a count of each word leave Python, and a context of words is scored once.
    """

    @F.pandas_udf("array<struct<share:double,observations:double>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model, lambda scores, seen: {"share": noun_share(scores), "observations": float(seen)})
        for sentences in batches:
            yield pd.Series([None if w is None else scorer(list(w)) for w in sentences], dtype=object)

    return lambda words: F.zip_with(run(words), words, lambda t, w: exprs.noun_mix(t["share"], t["observations"], w))


def dedup_submissions(submissions: DataFrame, domains: DataFrame | None = None, source: str = "file") -> DataFrame:
    """Submissions with url and title, of whitelisted domains if given, one per host and path in each source file."""
    whole = submissions.where("url is not null and title is not null").withColumn("host", exprs.url_host(F.col("url"))).withColumn("path", exprs.url_path(F.col("url")))
    if domains is not None:
        whole = whole.withColumn("domain", exprs.host_domain(F.col("host"))).join(domains.select("domain"), "domain", "left_semi")
    return whole.dropDuplicates([source, "host", "path"])


def relevance(sentences: DataFrame, span_map: DataFrame, postings_: DataFrame, model: Perceptron) -> DataFrame:
    """``sentences(month, id, title)`` -> (month, node_id, relevance): weights of the terms found, each by how noun-like its words are.

    A term's finds are summed for each month before its nodes join, so a term of many finds and many nodes costs their sum, not their product.
    """
    words = sentences.select("month", "id", exprs.normalised_words(F.col("title")).alias("words"))
    scored = words.withColumn("nouns", word_nouns(model)(F.col("words")))
    found = spans(scored, span_map)
    sums = found.groupBy("month", "term").agg(F.sum(exprs.span_mean(F.col("nouns"), F.col("pos"), F.col("width"))).alias("nouns"))
    return sums.join(postings_, "term").groupBy("month", "node_id").agg(F.sum(F.col("weight") * F.col("nouns")).alias("relevance"))


def quarters(monthly: DataFrame, month: str = "month") -> DataFrame:
    """``monthly`` with ``quarter``: months numbered in order and grouped by three from the end, so the first group may be short."""
    numbered = monthly.select(month).distinct().withColumn("i", F.row_number().over(Window.orderBy(month)) - 1)
    last = numbered.agg(F.max("i").alias("last"))
    groups = numbered.crossJoin(F.broadcast(last)).select(month, (F.floor(F.col("last") / 3) - F.floor((F.col("last") - F.col("i")) / 3)).cast("long").alias("quarter"))
    return monthly.join(F.broadcast(groups), month)


def quarter_ranks(monthly: DataFrame) -> DataFrame:
    """(quarter, node_id, relevance, rank): rank 1 has the highest relevance of its quarter; ties by node."""
    return ranked_quarters(quarters(monthly).groupBy("quarter", "node_id").agg(F.sum("relevance").alias("relevance")))


def ranked_quarters(sums: DataFrame) -> DataFrame:
    return sums.withColumn("rank", F.row_number().over(Window.partitionBy("quarter").orderBy(F.desc("relevance"), "node_id")))


def ever_top(ranks: DataFrame, k: int = 80_000) -> DataFrame:
    """Nodes among the first k of any quarter."""
    return ranks.groupBy("node_id").agg(F.max((F.col("rank") <= k).cast("int")).alias("hit")).where("hit = 1").select("node_id")


def rank_matrix(ranks: DataFrame, k: int = 80_000) -> DataFrame:
    """(node_id, quarter, rank) of nodes ever among the first k; pivot it for a matrix."""
    return ranks.join(ever_top(ranks, k), "node_id", "left_semi").select("node_id", "quarter", "rank")


def comparative_ranks(ranks: DataFrame, selection: DataFrame) -> DataFrame:
    """Ranks within a selection of nodes, quarter by quarter."""
    chosen = ranks.join(selection.select("node_id"), "node_id", "left_semi")
    return chosen.select("quarter", "node_id", F.row_number().over(Window.partitionBy("quarter").orderBy("rank")).alias("place"))
