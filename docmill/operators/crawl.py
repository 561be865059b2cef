"""Link extraction, crawl order and reports over fetched pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.functions.arrays import explode_rows
from docmill.operators.ranking import top_per_key
from docmill.session import cut_lineage

MAX_DEPTH = 2
MAX_PAGES = 100


def extract_links(pages: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Internal links of every page, absolute, in page order: ``url, position, link``."""
    def form(group: int) -> Column:
        return F.regexp_extract_all("html", F.lit(f"(?i){T.LINK_START}"), F.lit(group))

    either = F.zip_with(form(1), form(2), lambda a, b: F.concat(a, b))
    found = F.transform(F.zip_with(either, form(3), lambda a, b: F.concat(a, b)), T.unescape)
    rows = explode_rows(pages.select(*keep, "url", found.alias("_f")), "_f", [*keep, "url"], "href", "position")
    link = T.resolve_url(F.col("url"), F.col("href"))
    rows = rows.where(F.col("href") != "").select(*keep, "url", "position", link.alias("link"))
    return rows.where(T.url_authority(F.col("link")) == T.url_authority(F.col("url")))


def matches_any(url: Column, patterns: Column) -> Column:
    return F.exists(patterns, lambda p: F.rlike(url, p))


def follow_filter(
    links: DataFrame, sources: DataFrame, visited: DataFrame | None = None
) -> DataFrame:
    """Links a source may follow, with its ``name``: same authority as ``base_url``, no exclude
    pattern, one of the include patterns where there are any, not yet visited."""
    sites = sources.select(
        "name",
        T.url_authority(F.col("base_url")).alias("authority"),
        "url_patterns",
        "exclude_patterns",
    )
    rows = links.withColumn("authority", T.url_authority(F.col("link"))).join(sites, "authority")
    rows = rows.where(
        ~matches_any(F.col("link"), F.col("exclude_patterns"))
        & ((F.size("url_patterns") == 0) | matches_any(F.col("link"), F.col("url_patterns")))
    ).drop("authority", "url_patterns", "exclude_patterns")
    if visited is not None:
        rows = rows.join(visited.select(F.col("url").alias("link")), "link", "left_anti")
    return rows


def crawl_frontier(
    starts: DataFrame,
    links: DataFrame,
    fetched: DataFrame,
    max_depth: int = MAX_DEPTH,
    max_pages: int = MAX_PAGES,
) -> DataFrame:
    """Pages of each source in the order a first-in-first-out crawl visits them:
    ``name, url, depth, visit``.

    ``starts`` (name, url, position) are depth 0, ``links`` (name, url, position, link) are
    allowed links, ``fetched`` (url) the pages that could be read; only those pass links on.
    A page belongs to its first finder, and each source stops at ``max_pages``. One round per
    depth; a round keeps at most ``max_pages`` rows per source and is checkpointed.
    """
    def cut(found: DataFrame, used: DataFrame | None, depth: int) -> DataFrame:
        first = found.groupBy("name", "url").agg(F.min("place").alias("place"))
        if used is not None:
            first = first.join(used.select("name", "url"), ["name", "url"], "left_anti")
        ranked = top_per_key(
            first, ["name"], [F.col("place"), F.col("url")], max_pages, "_n", salt=F.col("url")
        )
        if used is not None:
            seen = used.groupBy("name").agg(F.count(F.lit(1)).alias("_seen"))
            ranked = ranked.join(seen, "name", "left").withColumn(
                "_n", F.col("_n") + F.coalesce("_seen", F.lit(0))
            )
        kept = ranked.where(F.col("_n") <= max_pages).select(
            "name", "url", F.lit(depth).alias("depth"), F.col("_n").cast("int").alias("visit")
        )
        return cut_lineage(kept)

    links = cut_lineage(links.select("name", "url", "position", "link"))  # read by every round
    # place = (visit number of the finder, position on its page)
    seeds = starts.select(
        "name", "url", F.struct(F.lit(0).alias("finder"), F.col("position").alias("at")).alias("place")
    )
    levels = [cut(seeds, None, 0)]
    for depth in range(1, max_depth + 1):
        used = reduce(DataFrame.unionByName, levels)
        readable = levels[-1].join(fetched.select("url"), "url", "left_semi")
        found = readable.select("name", "url", "visit").join(links, ["name", "url"]).select(
            "name",
            F.col("link").alias("url"),
            F.struct(F.col("visit").alias("finder"), F.col("position").alias("at")).alias("place"),
        )
        levels.append(cut(found, used, depth))
    return reduce(DataFrame.unionByName, levels)


def crawl_summary(results: DataFrame, by: list[str] = ("name",)) -> DataFrame:
    """Counters per source: successful, else failed with an error, else skipped."""
    ok = F.col("success")
    failed = ~ok & F.col("error").isNotNull() & (F.col("error") != "")
    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_urls"),
        F.count_if(ok).alias("successful"),
        F.count_if(failed).alias("failed"),
        F.count_if(~ok & ~failed).alias("skipped"),
        F.coalesce(
            F.try_divide(F.count_if(ok).cast("double"), F.count(F.lit(1)).cast("double")) * 100.0,
            F.lit(0.0),
        ).alias("success_rate"),
    )


def crawl_report(results: DataFrame, now: Column) -> DataFrame:
    """The lines of each source's summary document as rows ``name, section, line_no, line``,
    so a long list of pages is never one value. Needs name, url, visit, success, error, title."""
    totals = crawl_summary(results)
    # The lines of the report.
    head = F.array(
        F.concat(F.lit("# Crawl Summary: "), "name"),
        F.lit(""),
        F.concat(F.lit("**Date**: "), F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss")),
        F.concat(F.lit("**Total URLs**: "), F.col("total_urls").cast("string")),
        F.concat(F.lit("**Successful**: "), F.col("successful").cast("string")),
        F.concat(F.lit("**Failed**: "), (F.col("total_urls") - F.col("successful")).cast("string")),
        F.lit(""),
    )
    top = totals.select("name", F.lit(0).alias("section"), F.posexplode(head).alias("line_no", "line"))

    def titles(section: int, title: str, where: Column) -> DataFrame:
        """Title, blank line, and the blank line after the section's last page."""
        ends = results.where(where).groupBy("name").agg((F.max("visit") + 2).cast("int").alias("_end"))
        lines = F.array(
            F.struct(F.lit(0).alias("no"), F.lit(title).alias("text")),
            F.struct(F.lit(1).alias("no"), F.lit("").alias("text")),
            F.struct(F.col("_end").alias("no"), F.lit("").alias("text")),
        )
        return ends.select("name", F.lit(section).alias("section"), F.explode(lines).alias("_l")).select(
            "name", "section", F.col("_l.no").alias("line_no"), F.col("_l.text").alias("line")
        )

    ok = F.col("success")
    line_no = (F.col("visit") + 1).cast("int").alias("line_no")
    good = results.where(ok).select(
        "name", F.lit(1).alias("section"), line_no,
        F.concat(F.lit("- ["), F.coalesce("title", F.lit("Untitled")), F.lit("]("), "url", F.lit(")"))
        .alias("line"),
    )
    bad = results.where(~ok).select(
        "name", F.lit(2).alias("section"), line_no,
        F.concat(F.lit("- "), "url", F.lit(": "), F.coalesce("error", F.lit("None"))).alias("line"),
    )
    parts = [top, titles(1, "## Successful Crawls", ok), good, titles(2, "## Failed Crawls", ~ok), bad]
    return reduce(DataFrame.unionByName, parts)


def title_case(col: Column) -> Column:
    """Every run of letters with a capital first letter."""
    runs = F.regexp_extract_all(col, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def site_inventory(files: DataFrame) -> DataFrame:
    """One row per folder of ``files`` (folder, path, content, modified): page count, newest
    time, title from the folder and the first address in the head of its first file. An address
    ends where the next one begins. The newest folder comes first."""
    head = F.substring("content", 1, 500)
    lines = F.filter(F.slice(F.split(head, "\n"), 1, 10), lambda s: F.contains(s, F.lit("http")))
    raw = F.regexp_extract(F.get(lines, F.lit(0)), rf"(http(?:(?!http)[^{T.WS_CLASS}])*)", 1)
    address = F.btrim(raw, F.lit("[]()\"',"))
    sites = files.groupBy("folder").agg(
        F.count(F.lit(1)).alias("pages_count"),
        F.max("modified").alias("scraped_at"),
        F.min_by(F.when(address != "", address), "path").alias("_url"),
    )
    return sites.select(
        "folder",
        F.coalesce("_url", F.concat(F.lit("https://"), "folder")).alias("url"),
        title_case(F.replace("folder", F.lit("-"), F.lit(" "))).alias("title"),
        "pages_count",
        "scraped_at",
    ).orderBy(F.col("scraped_at").desc(), "folder")


def inventory_totals(files: DataFrame, sites: DataFrame) -> DataFrame:
    """Number of PDF files, sites and pages."""
    zero = F.lit(0).cast("bigint")
    pdf = (F.col("type") == "pdf").cast("bigint")
    rows = files.select(pdf.alias("p"), zero.alias("s"), zero.alias("n")).unionByName(
        sites.select(zero.alias("p"), F.lit(1).cast("bigint").alias("s"), F.col("pages_count").alias("n"))
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return rows.agg(
        total("p").alias("pdf_documents"), total("s").alias("sites"), total("n").alias("pages")
    )
