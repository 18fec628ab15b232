"""The link graph: title collisions, redirects, ordered edges, degrees, and personalised PageRank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs
from ..functions.udfs import wt_hat_edges, wt_links
from ..storage import materialise
from .numbering import dense_ids


def overwritten(pages: DataFrame, title: str = "title", ts: str = "timestamp", id_: str = "id") -> DataFrame:
    """Ids of pages that a later page (by time, then id) of the same title overwrites.

    The winner is a partial aggregate, so a title of any number of pages needs no sort of its group.
    """
    best = pages.groupBy(title).agg(F.max(F.struct(ts, id_)).alias("best"))
    return pages.join(best, title).where(F.struct(ts, id_) < F.col("best")).select(id_)


def main_namespace(pages: DataFrame) -> DataFrame:
    return pages.where("ns = 0")


def moved_articles(pages: DataFrame) -> DataFrame:
    """Titles of redirects left by a move."""
    return main_namespace(pages).where(F.col("redirect").isNotNull() & F.contains("text", F.lit("{{R from move"))).select("id", "title", "redirect")


def articles(pages: DataFrame, lost: DataFrame | None = None) -> DataFrame:
    """Pages of the main namespace that are no redirects and not overwritten."""
    lost = overwritten(main_namespace(pages)) if lost is None else lost
    return main_namespace(pages).where("redirect is null").join(lost, "id", "left_anti")


def number_articles(pages: DataFrame) -> DataFrame:
    """Articles with their dense node_id, in the order of their ids."""
    return dense_ids(articles(pages), ["id"])


def resolve_redirects(redirects: DataFrame, targets: DataFrame) -> DataFrame:
    """``redirects(title, target)`` and ``targets(title, node_id)`` -> (title, node_id) of redirects that lead to a target.

    Pointers are doubled: a chain of n redirects takes about log2 n rounds.  A title that has its node
    stays as it is, one that leads to no redirect and no target drops out, and only the others are
    written again.  While any chain to a target is unfinished, each round finishes a title of it (the
    one just beyond those of the round before), so a round that finishes none leaves only pointers in
    or into cycles, or into chains that end nowhere.  Of several targets of one title the least stays.
    """
    once = redirects.where("title is not null and target is not null and title <> target").groupBy("title").agg(F.min("target").alias("target"))
    once = once.join(targets.select("title"), "title", "left_anti")
    ends = targets.select(F.col("title").alias("target"), "node_id", F.lit(True).alias("done"))
    now = materialise(once.join(ends, "target", "left").select("title", "target", "node_id", F.coalesce("done", F.lit(False)).alias("done")), "redirects")
    found = now.where("done").select("title", "node_id", "done")
    while True:
        rest = now.where("not done").select("title", "target", "done")
        if not rest.limit(1).count():
            break
        ahead = found.unionByName(rest.withColumnRenamed("target", "further"), allowMissingColumns=True).withColumnRenamed("title", "target")
        jumped = rest.drop("done").join(ahead, "target").where("done or further <> title")
        now = materialise(jumped.select("title", F.coalesce("further", "target").alias("target"), "node_id", "done"), "redirects")
        more = now.where("done").select("title", "node_id", "done")
        if not more.limit(1).count():
            break
        found = found.unionByName(more)
    return found.select("title", "node_id")


def title_map(numbered: DataFrame, redirects: DataFrame) -> DataFrame:
    """Every title that leads to a node: (title, node_id, is_redirect)."""
    own = numbered.select("title", "node_id", F.lit(False).alias("is_redirect"))
    return own.unionByName(resolve_redirects(redirects, numbered.select("title", "node_id")).withColumn("is_redirect", F.lit(True)))


def page_links(numbered: DataFrame) -> DataFrame:
    """(src, pos, title) of all links of all articles, in text order."""
    found = numbered.select(F.col("node_id").alias("src"), F.posexplode(wt_links("text")).alias("pos", "link"))
    return found.select("src", "pos", exprs.wiki_link(F.col("link")).alias("title")).where("title is not null")


def ordered_edges(links: DataFrame, titles: DataFrame) -> DataFrame:
    """``links(src, pos, title)`` resolved: (src, dst, link_idx), the place among resolved links, 7 for the eighth and later ones."""
    hit = links.join(titles.select("title", F.col("node_id").alias("dst")), "title").select("src", "pos", "dst")
    return hit.select("src", "dst", F.least(F.lit(7), F.row_number().over(Window.partitionBy("src").orderBy("pos", "dst")) - 1).alias("link_idx"))


def hat_edges(numbered: DataFrame, titles: DataFrame, strict: bool = True) -> DataFrame:
    """(src, dst, kind) of hatnotes.  In strict mode an article numbered 0 can't be reached by its own title."""
    found = numbered.select(F.col("node_id").alias("src"), F.inline(wt_hat_edges("text"))).withColumnRenamed("dest", "title")
    joined = found.join(titles.select("title", F.col("node_id").alias("dst"), "is_redirect"), "title")
    return joined.where("dst <> 0 or is_redirect" if strict else "true").select("src", "dst", "kind")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, in_degree, out_degree), repeated links and self-loops counted."""
    out = edges.groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("out_degree"))
    into = edges.groupBy(F.col("dst").alias("node_id")).agg(F.count(F.lit(1)).alias("in_degree"))
    zero = F.lit(0).cast("long")
    return nodes.select("node_id").join(into, "node_id", "left").join(out, "node_id", "left").select("node_id", F.coalesce("in_degree", zero).alias("in_degree"), F.coalesce("out_degree", zero).alias("out_degree"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, dst, p): share of a node's links that lead to each destination."""
    pairs = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("total"))
    return pairs.join(out, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("p"))


def log_degree_preference(degrees_: DataFrame) -> DataFrame:
    """(node_id, preference): log(out_degree + 2), normalised."""
    value = F.log(F.col("out_degree") + 2.0)
    total = degrees_.agg(F.sum(value).alias("total"))
    return degrees_.crossJoin(F.broadcast(total)).select("node_id", (value / F.col("total")).alias("preference"))


def normalised(df: DataFrame, value: str, name: str) -> DataFrame:
    """``df`` with ``value`` over its sum; the sum is one broadcast row."""
    return df.crossJoin(F.broadcast(df.agg(F.sum(value).alias("__total")))).withColumn(name, F.col(value) / F.col("__total")).drop("__total")


def personalised_pagerank(preference: DataFrame, adjacent: DataFrame, *, jump: float = 0.15, threshold: float = 1.0, min_iter: int = 0, max_iter: int = 200) -> DataFrame:
    """``preference(node_id, preference)`` and ``adjacent(src, dst, p)`` -> (node_id, value).

    Power iteration from the uniform vector, until perplexity changes by no more than ``threshold``
    (an absolute number, so small graphs stop early: see ``min_iter``).  Nodes without links out
    spread evenly.  A round is one join and one aggregation, written to the shared folder.
    """
    sources = adjacent.select(F.col("src").alias("node_id")).distinct().withColumn("linked", F.lit(True))
    fixed = materialise(preference.join(sources, "node_id", "left").select("node_id", "preference", F.col("linked").isNull().alias("sink")), "nodes")
    adjacent = materialise(adjacent.select("src", "dst", "p"), "adjacency")
    n = fixed.count()
    now = fixed.withColumn("value", F.lit(1.0 / max(n, 1)))

    def state() -> tuple[float, float]:
        row = now.agg(exprs.perplexity(F.col("value")), F.sum(F.when(F.col("sink"), F.col("value")).otherwise(0.0))).first()
        return row[0] or 0.0, row[1] or 0.0

    (now_perplexity, sink), before, rounds = state(), float("inf"), 0
    while (abs(before - now_perplexity) > threshold or rounds < min_iter) and rounds < max_iter:
        flow = adjacent.join(now.select(F.col("node_id").alias("src"), "value"), "src").groupBy(F.col("dst").alias("node_id")).agg(F.sum(F.col("p") * F.col("value")).alias("flow"))
        value = jump * F.col("preference") + (1 - jump) * F.coalesce("flow", F.lit(0.0)) + F.lit((1 - jump) * sink / n)
        now = materialise(fixed.join(flow, "node_id", "left").select("node_id", "preference", "sink", value.alias("value")), "rank")
        before, rounds = now_perplexity, rounds + 1
        now_perplexity, sink = state()
    return now.select("node_id", "value")


def ranked_table(values: DataFrame, degrees_: DataFrame, numbered: DataFrame) -> DataFrame:
    """(title, value, in_deg, out_deg) of all nodes."""
    joined = values.join(degrees_, "node_id").join(numbered.select("node_id", "title"), "node_id", "left")
    return joined.select("title", "value", F.col("in_degree").alias("in_deg"), F.col("out_degree").alias("out_deg"))


def top(df: DataFrame, by: Column | str, k: int, *ties: str) -> DataFrame:
    """The k largest, with their 0-based row number."""
    best = df.orderBy(F.desc(by), *ties).limit(k)
    return best.withColumn("row", F.row_number().over(Window.orderBy(F.desc(by), *ties)) - 1)


def page_slice(df: DataFrame, order: list[Column | str], page: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset(page * size).limit(size)


def census(df: DataFrame, column: str) -> DataFrame:
    """How many rows have a value (not null, not empty) and how many haven't."""
    kind = df.schema[column].dataType.typeName()
    filled = F.size(column) > 0 if kind == "array" else F.col(column) != "" if kind == "string" else F.col(column).isNotNull()
    return df.groupBy(F.coalesce(filled, F.lit(False)).alias("present")).agg(F.count(F.lit(1)).alias("n"))


def top_cite_domains(urls: DataFrame, k: int = 1024) -> DataFrame:
    """``urls(url)`` without scheme -> the k most cited domains, counted exactly; ties by name."""
    counted = urls.select(exprs.cite_domain(F.col("url")).alias("domain")).where("domain is not null").groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), "domain").limit(k)


def category_edges(pages: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Category graph from pages and ``links(row)`` of categorylinks (7 text fields): (cl_from, cl_to, cl_subcat), and rows whose category is unknown."""
    ids = pages.where("ns = 14 and redirect is null").select(exprs.category_name(F.col("title")).alias("name"), F.col("id").alias("cl_to"))
    rows = links.where("row[6] in ('page', 'subcat')").select(F.col("row")[0].cast("long").alias("cl_from"), exprs.category_title(F.col("row")[1]).alias("name"), (F.col("row")[6] == "subcat").alias("cl_subcat"))
    return rows.join(ids, "name").select("cl_from", "cl_to", "cl_subcat"), rows.join(ids, "name", "left_anti")
