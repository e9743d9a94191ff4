"""Page links, scope, robots rules and the crawl frontier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagequarry.functions import urls
from pagequarry.functions.tables import keep
from pagequarry.operators.dedup import top_by

SKIP = r"(?i)^(#|javascript:|mailto:|tel:|sms:|data:|blob:|file:|ftp:|chrome:|about:|edge:|vbscript:)"
ACTION = r"(?i)(logout|log-out|signout|sign-out|delete|remove|destroy|purge|abort|cancel)\b"
LOGIN = r"(?i)(login|login\.php|signin|auth|authenticate|password-reset|recover)"
MAX_DEPTH = 2


def is_followable(raw: Column) -> Column:
    """Whether the text of a link is worth resolving."""
    return (F.trim(raw) != "") & ~F.trim(raw).rlike(SKIP)


def is_page_link(url: Column) -> Column:
    """Whether an absolute link may lead to a page and is no action or login."""
    path = urls.path_of(url)
    return urls.is_http_url(url) & urls.is_html_page_url(url) & ~path.rlike(ACTION) & ~path.rlike(LOGIN)


def raw_links(pages: DataFrame) -> DataFrame:
    """page_id, url, link_no, href of the double-quoted anchors; built-in functions only, for regular HTML."""
    hrefs = F.regexp_extract_all("html", F.lit(r'<a\s[^>]*?href="([^"]*)"'), F.lit(1))
    return pages.select("page_id", "url", F.posexplode(hrefs).alias("link_no", "href"))


def resolve_links(links: DataFrame) -> DataFrame:
    """Adds abs_url to (url, href), resolved in place; what isn't worth following goes."""
    href = F.trim("href")
    absolute = urls.resolve(href, F.col("url"))
    # Through explode() no filter on abs_url is pushed, which would have each link resolved twice, by two Python workers of a task.
    return links.where(is_followable(F.col("href"))).select("*", F.explode(F.array(absolute)).alias("abs_url"))


def extract_links(elements: DataFrame) -> DataFrame:
    """page_id, link: the distinct page links of elements (page_id, url, tag, attrs)."""
    anchors = elements.where("tag = 'a'").select("page_id", "url", F.col("attrs")["href"].alias("href")).where("href is not null")
    return resolve_links(anchors).where(is_page_link(F.col("abs_url"))).select("page_id", F.col("abs_url").alias("link")).distinct()


def page_links(pages: DataFrame) -> DataFrame:
    """extract_links() from the HTML of pages by regular expression."""
    found = resolve_links(raw_links(pages)).where(is_page_link(F.col("abs_url")))
    return found.select("page_id", F.col("abs_url").alias("link")).distinct()


def in_scope(links: DataFrame, jobs: DataFrame, scope: str = "origin", url: str = "link") -> DataFrame:
    """links (job_id, ...) within "all", the same "origin" or registrable "site" as the job's root_url."""
    if scope == "all":
        return links
    part = urls.origin_of if scope == "origin" else urls.registrable_domain
    roots = jobs.select("job_id", part(F.col("root_url")).alias("_root"))
    return links.join(roots, "job_id").where(part(F.col(url)) == F.col("_root")).drop("_root")


def parse_robots(robots: DataFrame) -> DataFrame:
    """origin, rule_no, kind (allow, disallow, crawl-delay), pattern from (origin, body); groups of the agent * only."""
    lines = robots.select("origin", F.posexplode(F.split("body", r"\r?\n")).alias("no", "line"))
    text = F.trim(F.regexp_replace("line", "#.*$", ""))
    fields = lines.select("origin", "no", F.lower(F.trim(F.regexp_extract(text, r"^([^:]+):", 1))).alias("kind"), F.trim(F.regexp_extract(text, r"^[^:]+:(.*)$", 1)).alias("pattern"))
    agent = F.when(F.col("kind") == "user-agent", F.col("pattern") == "*")
    group = F.last(agent, ignorenulls=True).over(W.partitionBy("origin").orderBy("no").rowsBetween(W.unboundedPreceding, 0))
    rules = fields.withColumn("star", group).where("star and kind in ('allow', 'disallow', 'crawl-delay')")
    return rules.select("origin", F.col("no").alias("rule_no"), "kind", "pattern")


def crawl_delays(rules: DataFrame) -> DataFrame:
    """origin, crawl_delay: the last positive one in seconds."""
    d = F.regexp_extract("pattern", r"^([0-9]*\.?[0-9]+)", 1).try_cast("double")
    return rules.where("kind = 'crawl-delay'").withColumn("d", d).where("d > 0").groupBy("origin").agg(F.max_by("d", "rule_no").alias("crawl_delay"))


def crawl_delay_floor(rules: DataFrame, min_delay: int, max_delay: int) -> DataFrame:
    """One row: the longest delay of all origins in ms, within the limits."""
    ms = F.least(F.greatest(F.col("crawl_delay") * 1000, F.lit(float(min_delay))), F.lit(float(max_delay)))
    return crawl_delays(rules).agg(F.max(ms).alias("delay_ms"))


def _rule_regex(pattern: Column) -> Column:
    ends = pattern.endswith("$")
    bare = F.when(ends, F.regexp_replace(pattern, r"\$$", "")).otherwise(pattern)
    stars = F.regexp_replace(F.regexp_replace(bare, r"([.+?^${}()|\[\]\\])", r"\\$1"), r"\*", ".*")
    return F.concat(F.lit("^"), stars, F.when(ends & ~F.contains(pattern, F.lit("*")), "$").otherwise(".*"))


def robots_allowed(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """pages with allowed: the longest matching rule of the origin decides, an allow among equals; none: allowed.

    A literal rule is as long as its text; one with * matches to the end of the path, so the path's length counts. Literal rules
    are met by equal texts: a path is cut at the lengths that its origin's rules have, and the pieces are joined with the rules, so
    that the rules of a host, however many, never meet all its URLs. Only rules with * or $ are held against every path.
    """
    ask = pages.select(F.col(url).alias("_u")).distinct().withColumn("origin", urls.origin_of(F.col("_u")))
    path = F.concat(urls.path_of(F.col("_u")), F.regexp_extract("_u", r"(\?[^#]*)", 1))
    ask = ask.withColumn("path", F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)))
    own = rules.where("kind in ('allow', 'disallow') and pattern <> ''").withColumn("wild", F.col("pattern").rlike(r"\*|\$$"))
    each = own.groupBy("origin", "pattern", "wild").agg(F.bool_or(F.col("kind") == "allow").alias("allow"))
    literal, wild = each.where("not wild"), each.where("wild").withColumn("rx", _rule_regex(F.col("pattern")))
    lengths = literal.groupBy("origin").agg(F.collect_set(F.length("pattern")).alias("lengths"))
    cuts = F.transform(F.filter("lengths", lambda n: n <= F.length("path")), lambda n: F.substring("path", F.lit(1), n))
    pieces = ask.join(lengths, "origin").select("_u", "origin", F.explode(cuts).alias("pattern"))
    met = pieces.join(literal, ["origin", "pattern"]).select("_u", F.length("pattern").alias("n"), "allow")
    wildly = ask.join(wild, "origin").where(F.expr("regexp_like(path, rx)")).select("_u", F.expr("length(regexp_extract(path, rx, 0))").alias("n"), "allow")
    best = met.unionByName(wildly).groupBy("_u").agg(F.max(F.struct("n", "allow")).alias("b"))
    return pages.join(best.select(F.col("_u").alias(url), F.col("b.allow").alias("allowed")), url, "left").withColumn("allowed", F.coalesce("allowed", F.lit(True)))


def is_html_content_type(c: Column) -> Column:
    return c.isNull() | (c == "") | F.lower(c).rlike(r"text/html|application/xhtml|^text/")


def expand_frontier(edges: DataFrame, jobs: DataFrame, rules: DataFrame | None = None, scope: str = "all", max_depth: int = MAX_DEPTH, max_pages: int | None = None, cut=keep) -> DataFrame:
    """job_id, url, depth of the pages that a job reaches from its root_url over edges (src_url, dst_url and, where there is an order
    of arrival, seq).

    Links of one level that are in scope, not seen before and allowed make the next; there are at most max_depth rounds. With
    max_pages, a job's pages are taken level by level in order of arrival, then URL, and what robots rules reject holds its
    place; the root counts. cut writes the links once and each level to a table, so that a level reads the last one only.
    """
    order = [F.min("seq").alias("seq")] if "seq" in edges.columns else [F.lit(0).alias("seq")]
    links = cut(edges.groupBy(urls.canonical_url(F.col("src_url")).alias("src"), urls.canonical_url(F.col("dst_url")).alias("dst")).agg(*order))
    level = cut(jobs.select("job_id", urls.canonical_url(F.col("root_url")).alias("url"), F.lit(0).alias("depth")))
    seen, places = level, level.groupBy("job_id").agg(F.count("*").alias("taken"))
    for depth in range(1, max_depth + 1):
        reached = level.join(links, level["url"] == links["src"]).groupBy("job_id", F.col("dst").alias("url")).agg(F.min("seq").alias("seq"))
        new = in_scope(reached, jobs, scope, "url").join(seen.select("job_id", "url"), ["job_id", "url"], "left_anti")
        if max_pages is not None:
            first = top_by(new, ["job_id"], [F.col("seq"), F.col("url")], max_pages)  # so many rows of a job at most
            number = F.row_number().over(W.partitionBy("job_id").orderBy("seq", "url"))
            new = cut(first.withColumn("number", number).join(places, "job_id").where(F.col("number") + F.col("taken") <= max_pages).select("job_id", "url", "seq"))
            places = cut(places.unionByName(new.groupBy("job_id").agg(F.count("*").alias("taken"))).groupBy("job_id").agg(F.sum("taken").alias("taken")))
        if rules is not None:
            new = robots_allowed(new, rules).where("allowed").drop("allowed")
        level = cut(new.select("job_id", "url", F.lit(depth).alias("depth")))
        seen = seen.unionByName(level)
    return seen


def cap_pages(frontier: DataFrame, max_pages: int) -> DataFrame:
    """The first max_pages of each job by priority (1000 - 300 * depth), then order; limit_reached tells if more came."""
    total = frontier.groupBy("job_id").agg((F.count("*") > max_pages).alias("limit_reached"))
    return top_by(frontier, ["job_id"], [F.col("depth"), F.col("seq")], max_pages).join(total, "job_id")


def cap_images(candidates: DataFrame, max_images: int) -> DataFrame:
    total = candidates.groupBy("job_id").agg((F.count("*") > max_images).alias("limit_images_reached"))
    return top_by(candidates, ["job_id"], [F.col("seq")], max_images).join(total, "job_id")


def page_index(candidates: DataFrame) -> DataFrame:
    """job_id, source_page_url, page_no in order of first appearance."""
    first = candidates.groupBy("job_id", "source_page_url").agg(F.min("seq").alias("first"))
    return first.select("job_id", "source_page_url", F.row_number().over(W.partitionBy("job_id").orderBy("first")).alias("page_no"))


def links_per_host(pages: DataFrame) -> DataFrame:
    """For each host, how many distinct page links its pages have after canonicalisation."""
    links = page_links(pages).select("page_id", urls.canonical_url(F.col("link")).alias("link"))
    hosts = pages.select("page_id", urls.hostname_of(F.col("url")).alias("host"))
    return hosts.join(links, "page_id").groupBy("host").agg(F.count_distinct("link").alias("n_links"))

