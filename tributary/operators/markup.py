"""Selection of elements of HTML pages by tag and class, with the links and texts inside them.

A page becomes rows, one for each tag or stretch of text, by one pattern; what matches what is then told by windows over a
page's rows, so neither a tree nor a join of elements with links is built. A page's rows meet in one task; pages do not.

Defined results: comments and the content of scripts, styles, titles and text areas are no markup and no text; an element
that is not closed reaches to the end of its page; end tags without a start are ignored; a link inside nested selected
elements belongs to each of them; an ``a`` begun before the last one's end ends that one; null pages have no elements. The
named character references ``amp lt gt quot apos nbsp`` and ``&#39;`` are decoded, others stay as they are written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_INSIDE = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
#: Comment, element whose content is no markup, tag, text.
_TOKEN = rf"(?is)<!--.*?(?:-->|\z)|<[!?][^>]*+>|<(script|style|title|textarea)(?=[\s/>]){_INSIDE}>.*?(?:</\1\s*>|\z)|</?[a-z]{_INSIDE}>|[^<]++|<"
_TAG = r"(?s)^</?([A-Za-z][^\s/>]*)"
_REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def unescaped(text: Column) -> Column:
    for said, meant in _REFERENCES:
        text = F.replace(text, F.lit(said), F.lit(meant))
    return text


def attribute(token: Column, name: str) -> Column:
    """Value of an attribute of a start tag, the first if it is repeated; null without it."""
    # Quoted values before it are passed whole, as they may hold anything.
    before = r"""(?is)^<[a-z](?:[^>"'\s]++|"[^"]*+"|'[^']*+'|\s(?!""" + name + r"""\s*=))*+\s"""
    pattern = before + name + r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    found = F.concat(*(F.regexp_extract(token, pattern, k) for k in (1, 2, 3)))
    return F.when(F.regexp_like(token, F.lit(pattern)), unescaped(found))


def tokens(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, at, token, tag, step): tags and texts in order; ``step`` is 1 for a start, -1 for an end and 0 for text."""
    each = pages.select(key, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(_TOKEN), F.lit(0))).alias("at", "token"))
    tag = F.lower(F.regexp_extract("token", _TAG, 1))
    step = F.when(tag == "", 0).when(F.startswith("token", F.lit("</")), -1).otherwise(1)
    other = F.startswith("token", F.lit("<!")) | F.startswith("token", F.lit("<?"))
    raw = tag.isin("script", "style", "title", "textarea")
    return each.where(~other).select(key, "at", "token", tag.alias("tag"), step.alias("step")).where(~raw)


def selected(pages: DataFrame, tag: str, class_: str | None = None, key: str = "page_id", html: str = "html") -> DataFrame:
    """``tokens`` with ``start`` (the place of the element that begins there, null elsewhere), ``element`` (how many selected
    elements began so far) and ``inside`` (how many of them hold the row, their own start included)."""
    rows = tokens(pages, key, html)
    order = Window.partitionBy(key).orderBy("at")
    mine = F.col("tag") == tag
    depth = rows.withColumn("depth", F.sum(F.when(mine, F.col("step")).otherwise(0)).over(order))
    # A start and its end share the depth that the start leads to.
    level = depth.withColumn("depth", F.when(mine & (F.col("step") < 0), F.col("depth") + 1).otherwise(F.col("depth")))
    wanted = mine & (F.col("step") > 0)
    if class_ is not None:
        wanted &= F.coalesce(F.array_contains(F.split(attribute(F.col("token"), "class"), r"\s+"), class_), F.lit(False))
    marked = level.withColumn("start", F.when(wanted, F.col("at")))
    # Of the tag's starts and ends at one depth, an end belongs to the row before it, if that is a start.
    turn = Window.partitionBy(key, "depth", mine).orderBy("at")
    ends = mine & (F.col("step") < 0) & F.lag("start").over(turn).isNotNull()
    change = marked.withColumn("change", F.when(F.col("start").isNotNull(), 1).when(ends, -1).otherwise(0))
    return change.select(key, "at", "token", "tag", "step", "start", F.count("start").over(order).alias("element"), F.sum("change").over(order).alias("inside"))


def _held(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """``wanted`` (key, at, inside, ...) once for each element of ``rows`` that holds the row, with its number as ``element``."""
    begun = rows.where("start is not null").select(key, "at", F.col("inside").alias("level"), F.col("element").alias("begun"))
    spread = wanted.where("inside > 0").withColumn("level", F.explode(F.sequence(F.lit(1), F.col("inside").cast("int"))))
    both = spread.unionByName(begun, allowMissingColumns=True)
    # The element of a level that holds a row is the last one of that level before it, or the row itself.
    last = Window.partitionBy(key, "level").orderBy("at", F.col("begun").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("element", F.last("begun", True).over(last)).where("begun is null").drop("begun", "level")


def links(pages: DataFrame, tag: str, class_: str | None = None, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, element, link, href, text): links with an address inside each element of a tag and class, both numbered from 1."""
    rows = selected(pages, tag, class_, key, html)
    anchor = F.col("tag") == "a"
    # From one start or end of an ``a`` to the next; text counts where a start is the first of them.
    parts = rows.withColumn("a", F.count(F.when(anchor, 1)).over(Window.partitionBy(key).orderBy("at"))).where("a > 0")
    words = F.collect_list(F.when(F.col("step") == 0, F.struct("at", "token")))
    each = parts.groupBy(key, "a").agg(F.min_by(F.struct("at", "token", "step", "inside"), "at").alias("first"), F.sort_array(words).alias("words"))
    held = _held(rows, key, each.where("first.step = 1").select(key, "first.at", "first.token", "first.inside", "words"))
    text = unescaped(F.array_join(F.transform("words", lambda w: w["token"]), ""))
    addressed = held.withColumn("href", attribute(F.col("token"), "href")).where("href is not null")
    place = F.row_number().over(Window.partitionBy(key, "element").orderBy("at"))
    return addressed.select(key, "element", place.cast("long").alias("link"), "href", text.alias("text"))


def texts(pages: DataFrame, tag: str, class_: str | None = None, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, element, text): the text inside each element of a tag and class, in one piece."""
    rows = selected(pages, tag, class_, key, html)
    held = _held(rows, key, rows.where("step = 0").select(key, "at", "inside", "token")).groupBy(key, "element").agg(F.sort_array(F.collect_list(F.struct("at", "token"))).alias("w"))
    all_ = rows.where("start is not null").select(key, "element")
    return all_.join(held, [key, "element"], "left").select(key, "element", unescaped(F.array_join(F.transform("w", lambda w: w["token"]), "")).alias("text")).na.fill("", ["text"])
