"""Links of listings: what cannot be a brochure, tracking wrappers, and how much an anchor looks like one."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from ..functions.schema import let

# Hosts of profiles, words of links other than brochures, wordings around administrative links.
PROFILE_HOSTS = ["linkedin.com", "instagram.com", "twitter.com", "x.com", "facebook.com", "rics.org"]
OTHER_WORDS = ["download", "floorplan", "floor plan"]
ADMIN_WORDS = ["unsubscribe", "preferences", "view in browser", "opt out", "opt-out", "manage your subscription", "subscribed to our list", "update your"]
ADMIN_CONTEXT = 100


def _any_word(words: list[str]) -> str:
    return "|".join(w.replace(".", r"\.") for w in words)


def clean_path(c: Column) -> Column:
    """Lower case, without query and fragment."""
    return F.regexp_extract(F.lower(c), "^([^?#]*)", 1)


def full_url(c: Column) -> Column:
    """With https:// if there is no scheme."""
    return F.when(c.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), c).otherwise(F.concat(F.lit("https://"), c))


def url_host(c: Column) -> Column:
    return F.regexp_extract(full_url(c), r"^[^:/?#]+://([^/?#]*)", 1)


def is_generic_link(c: Column) -> Column:
    """A profile page, or a host without a path and a query."""
    rest = F.regexp_extract(full_url(c), r"^[^:/?#]+://[^/?#]*([^?#]*)(\?[^#]+)?", 1)
    query = F.regexp_extract(full_url(c), r"^[^:/?#]+://[^/?#]*[^?#]*\?([^#]*)", 1)
    profile = url_host(c).rlike(rf"(^|\.)({_any_word(PROFILE_HOSTS)})$")
    return profile | (rest.rlike("^/*$") & (query == ""))


def unwrap_tracking(c: Column) -> Column:
    """The target of a known tracking link, null if the link is no such wrapper."""
    raw = F.try_url_decode(F.regexp_extract(c, r"[?&]msdynmkt_target=([^&#]+)", 1))
    target = F.try_url_decode(F.get_json_object(F.coalesce(F.try_url_decode(raw), raw), "$.TargetUrl"))
    return F.when(url_host(c).contains("dynamics.com"), F.nullif(target, F.lit("")))


def score_link(href: Column, text: Column) -> Column:
    """3 for a PDF called brochure, 2 for another PDF, 1 for the word brochure or download alone, else 0."""
    path, label = clean_path(href), F.lower(F.coalesce(text, F.lit("")))
    pdf = path.endswith(".pdf")
    named = path.contains("brochure") | label.contains("brochure")
    other = path.rlike(_any_word(OTHER_WORDS)) | label.rlike(_any_word(OTHER_WORDS))
    return F.when(pdf & named, 3).when(pdf, 2).when(named | other, 1).otherwise(0)


def is_admin_link(c: Column) -> Column:
    return F.coalesce(F.lower(c).rlike(_any_word(ADMIN_WORDS)), F.lit(False))


def finalize_link(raw: Column, resolved: Column, is_pdf: Column, fallback: Column) -> Column:
    """The resolved link of a genuine raw one; else a PDF's own link; else null."""
    genuine = F.when(raw.isNotNull() & ~is_admin_link(raw) & (raw != "") & ~is_generic_link(raw), F.coalesce(resolved, raw))
    return F.coalesce(genuine, F.when(is_pdf, fallback))


class _Anchors(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found: list[list[str]] = []
        self.open = False

    def handle_starttag(self, tag, attrs):
        if tag == "a" and (href := dict(attrs).get("href")):
            self.found.append([href, ""])
            self.open = True

    def handle_data(self, data):
        if self.open:
            self.found[-1][1] += data

    def handle_endtag(self, tag):
        if tag == "a":
            self.open = False


#: Pages whose anchors a task holds at once.
PAGES = 64


def anchor_rows(batches):
    """Record batches (page_id, url, at, href, text) of the anchors of pages, in order; a page is text only while it is parsed."""
    for batch in batches:
        ids, urls, html = (batch.column(c) for c in ("page_id", "url", "html"))
        for start in range(0, batch.num_rows, PAGES):
            rows = []
            for k in range(start, min(start + PAGES, batch.num_rows)):
                parser = _Anchors()
                parser.feed(html[k].as_py() or "")
                rows += [(k, at, h, " ".join(t.split())) for at, (h, t) in enumerate(parser.found)]
            k = pa.array([r[0] for r in rows], pa.int64())
            found = [pa.array([r[n] for r in rows], t) for n, t in ((1, pa.int32()), (2, pa.string()), (3, pa.string()))]
            yield pa.RecordBatch.from_arrays([ids.take(k), urls.take(k), *found], names=["page_id", "url", "at", "href", "text"])


@F.pandas_udf(StringType())
def _join_url(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([urljoin(b or "", h) for b, h in zip(base, href, strict=True)])


def best_links(pages: DataFrame) -> DataFrame:
    """(page_id, link, score): the anchor of each page that looks most like a brochure; the first of equals, none at 0 or within the page."""
    of = StructType([pages.schema["page_id"], pages.schema["url"]]).add("at", IntegerType()).add("href", StringType()).add("text", StringType())
    flat = pages.select("page_id", "url", "html").mapInArrow(anchor_rows, of).where("not startswith(href, '#')")
    flat = flat.withColumn("score", score_link(F.col("href"), F.col("text"))).where("score > 0")
    best = flat.groupBy("page_id").agg(F.max(F.struct("score", (-F.col("at")).alias("first"), "url", "href")).alias("m"))
    return best.select("page_id", _join_url("m.url", "m.href").alias("link"), F.col("m.score").alias("score"))


def resolve_links(links: DataFrame, responses: DataFrame, checkpoint, hops: int = 20) -> DataFrame:
    """(url, link, outcome, hops) of distinct links (url): where each leads, as its pages answered.

    responses (url, status, location, html) are what a fetch of each url gave, one for each. A PDF is itself; a
    tracking wrapper is what it wraps, unless that is a mail address. Answers from 300 to 399 lead on, at most
    `hops` times; the page at the end gives its best anchor, or itself if none looks like a brochure. A link
    stays as it is (without wrappers) if an answer is missing or no success, or if it runs in a circle. outcome
    is document, mail, anchor, page, dead or circle. checkpoint(df, name) keeps each round, and only links that
    are still on their way are joined again.
    """
    start = full_url(F.col("url"))
    way = links.select("url").where("url is not null").distinct().select("url", start.alias("start"), start.alias("at"), F.lit(0).alias("hops"), F.lit(True).alias("fresh"))
    told = responses.groupBy("url").agg(F.min(F.struct("status", "location")).alias("r")).select(F.col("url").alias("at"), "r.*", F.lit(True).alias("known"))
    ended = []
    for _ in range(2 * hops + 2):
        target = F.when(F.col("fresh"), unwrap_tracking(F.col("at")))
        seen = way.withColumn("target", target).withColumn("pdf", F.col("fresh") & clean_path(F.col("at")).endswith(".pdf"))
        next_ = F.col("status").between(300, 399) & F.col("location").isNotNull()
        outcome = (
            F.when(F.col("pdf"), "document")
            .when(F.col("target").startswith("mailto:"), "mail")
            .when(F.col("target").isNotNull(), None)
            .when(F.col("known").isNull() | ~(F.col("status").between(200, 299) | next_), "dead")
            .when(next_ & (F.col("hops") >= hops), "circle")
            .when(~next_, "page")
        )
        found = checkpoint(seen.join(told, "at", "left").withColumn("outcome", outcome), "hop")
        ended.append(found.where("outcome is not null").select("url", "start", "at", "hops", "outcome"))
        found = found.where("outcome is null")
        if found.isEmpty():
            break
        inner = full_url(F.col("target"))
        moved = F.when(F.col("target").isNotNull(), inner).otherwise(_join_url("at", "location"))
        way = found.select("url", F.coalesce(inner, "start").alias("start"), moved.alias("at"), F.when(F.col("target").isNull(), F.col("hops") + 1).otherwise(0).alias("hops"), F.col("target").isNotNull().alias("fresh"))
    else:  # wrappers in wrappers without end
        ended.append(way.select("url", "start", "at", "hops", F.lit("circle").alias("outcome")))
    every = ended[0]
    for more in ended[1:]:
        every = every.unionByName(more)
    every = checkpoint(every, "ends")
    reached = every.where("outcome = 'page'").select(F.col("at").alias("url")).distinct()
    pages = responses.join(reached, "url", "left_semi").groupBy("url").agg(F.min("html").alias("html"))
    best = best_links(pages.select(F.col("url").alias("page_id"), "url", "html")).select(F.col("page_id").alias("at"), F.col("link").alias("best"))
    out = every.join(best, "at", "left")
    page = F.col("outcome") == "page"
    link = F.when(page, F.coalesce("best", "at")).when(F.col("outcome") == "document", F.col("at")).otherwise(F.col("start"))
    return out.select("url", link.alias("link"), F.when(page & F.col("best").isNotNull(), "anchor").otherwise(F.col("outcome")).alias("outcome"), "hops")


def resolve_email_links(text: Column) -> Column:
    """Email text in which links in angle brackets stand bare, and only if they are neither administrative nor generic.

    The text is cut at links; each piece is joined again with its link or without. A link is
    administrative by its own words or those in the ADMIN_CONTEXT characters before it, in which
    earlier links count; one that leads to a generic link is generic. That context is built from the
    few pieces just before, as each earlier link takes more than ten characters of it.
    """
    pattern = r"<(https?://[^>\s]+)>"
    reach = ADMIN_CONTEXT // len("<http://x>") + 1

    def one(between, urls, k):
        back = F.least(k, F.lit(reach))
        earlier = F.zip_with(F.slice(between, k - back + 1, back), F.slice(urls, k - back + 1, back), lambda t, u: F.concat(t, F.lit("<"), u, F.lit(">")))
        before = F.concat(F.array_join(earlier, ""), F.get(between, k))
        target = F.coalesce(unwrap_tracking(F.get(urls, k)), F.get(urls, k))

        def kept(url, to):
            drop = url.isNull() | is_admin_link(F.right(before, F.lit(ADMIN_CONTEXT))) | is_admin_link(url) | is_generic_link(url) | is_generic_link(to)
            return F.when(drop, F.lit("")).otherwise(to)

        return F.concat(F.get(between, k), let(F.struct(F.get(urls, k).alias("url"), target.alias("to")), lambda x: kept(x["url"], x["to"])))

    def joined(p):
        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(p["between"]) - 1), lambda k: one(p["between"], p["urls"], k)), "")

    return let(F.struct(F.split(text, pattern).alias("between"), F.regexp_extract_all(text, F.lit(pattern), 1).alias("urls")), joined)
