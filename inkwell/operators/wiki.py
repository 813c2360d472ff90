"""Pages, their tree, links, tags, revisions and occurrences, as DataFrame operations on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .search import canonical_space
from .store import insert_missing, upsert

PATCHABLE = ("title", "body_html", "type", "sensitivity", "owner", "status", "review_due", "position", "template_key")
PAGE = "id long, space string, parent_id long, title string, body_html string, body_text string, type string, sensitivity string, template_key string, owner string, status string, review_due string, position int, created_at string, updated_at string"
REVISION = "page_id long, title string, body_html string, note string, origin string, created_at string"


def tree(pages: DataFrame, space: str) -> DataFrame:
    return pages.where(F.col("space") == canonical_space(space)).orderBy(F.desc("type"), "position", "title")


def get(pages: DataFrame, tags: DataFrame, links: DataFrame, occurrences: DataFrame, id_: int) -> dict | None:
    """A page with its tags, the pages that link to it, and what was found in it."""
    page = pages.where(F.col("id") == id_).first()
    if page is None:
        return None
    back = links.where(F.col("dst_page_id") == id_).join(pages.select(F.col("id").alias("src_page_id"), "title"), "src_page_id").select("src_page_id", "title").distinct().orderBy("title")
    return page.asDict() | {
        "tags": sorted(r["name"] for r in tags.where(F.col("page_id") == id_).select("name").distinct().collect()),
        "backlinks": [r.asDict() for r in back.collect()],
        "occurrences": [r.asDict() for r in occurrences.where(F.col("page_id") == id_).collect()],
    }


def create(pages: DataFrame, rows: DataFrame, at: str) -> DataFrame:
    """pages with new rows (space, title, body_html and any other field), ids in order of title; text is derived."""
    top = pages.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
    empty = pages.sparkSession.createDataFrame([], PAGE)
    new = empty.unionByName(rows, allowMissingColumns=True)
    new = new.withColumn("id", F.lit(top) + F.row_number().over(Window.orderBy("space", "title")))
    defaults = {"type": "note", "sensitivity": "Internal", "status": "draft", "position": 0}
    new = new.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})
    new = new.withColumns({"body_text": T.html_to_text(F.coalesce("body_html", F.lit(""))), "created_at": F.lit(at), "updated_at": F.lit(at)})
    return pages.unionByName(new.select(pages.columns))


def update(pages: DataFrame, revisions: DataFrame, patch: DataFrame, at: str, origin: str = "user") -> tuple[DataFrame, DataFrame]:
    """(pages, revisions) after a patch (id and fields to set; null leaves a field). A change of title or body keeps the old version."""
    fields = [c for c in patch.columns if c in PATCHABLE]
    p = patch.select("id", *[F.col(c).alias(f"_{c}") for c in fields])
    both = pages.join(p, "id", "left").withColumn("_hit", F.lit(False))
    hit = pages.join(p, "id")
    text = [c for c in ("title", "body_html") if c in fields]
    changed = F.lit(False)
    for c in text:
        changed = changed | (F.col(f"_{c}").isNotNull() & ~F.col(c).eqNullSafe(F.col(f"_{c}")))
    old = hit.where(changed).select(F.col("id").alias("page_id"), "title", "body_html", F.lit(None).cast("string").alias("note"), F.lit(origin).alias("origin"), F.lit(at).alias("created_at"))
    set_to = {c: F.coalesce(f"_{c}", c) for c in fields}
    out = both.withColumn("updated_at", F.when(F.coalesce(*[F.col(f"_{c}").cast("string") for c in fields]).isNotNull(), F.lit(at)).otherwise(F.col("updated_at"))).withColumns(set_to)
    if "body_html" in fields:
        out = out.withColumn("body_text", F.when(F.col("_body_html").isNotNull(), T.html_to_text("body_html")).otherwise(F.col("body_text")))
    return out.select(pages.columns), revisions.unionByName(old)


def revisions_of(revisions: DataFrame, page_id: int, limit: int = 100) -> DataFrame:
    return revisions.where(F.col("page_id") == page_id).orderBy(F.desc("created_at")).limit(limit)


def subtree(pages: DataFrame, root: int) -> DataFrame:
    """id, depth of a page and all below it, by a recursive query in one plan."""
    return pages.sparkSession.sql(
        f"""WITH RECURSIVE t(id, depth) AS (SELECT id, 0 FROM {{pages}} WHERE id = {int(root)}
        UNION ALL SELECT p.id, depth + 1 FROM {{pages}} p JOIN t ON p.parent_id = t.id) SELECT id, depth FROM t""",
        pages=pages.select("id", "parent_id"),
    )


def move(pages: DataFrame, id_: int, space: str) -> DataFrame:
    """The page to the top of another space, and all below it along with it."""
    moved = subtree(pages, id_).select("id", F.lit(canonical_space(space)).alias("_space"))
    out = pages.join(moved, "id", "left").withColumns({"space": F.coalesce("_space", "space"), "parent_id": F.when(F.col("id") != id_, F.col("parent_id"))})
    return out.select(pages.columns)


def remove(tables: dict[str, DataFrame], id_: int) -> dict[str, DataFrame]:
    """pages, and tables keyed by page_id or src_page_id, without a page; its children and links to it stay, unbound."""
    out = {}
    for name, df in tables.items():
        key = next(c for c in ("page_id", "src_page_id", "id") if c in df.columns)
        df = df.where(F.col(key) != id_)
        for c in ("parent_id", "dst_page_id"):
            if c in df.columns:
                df = df.withColumn(c, F.when(F.col(c) != id_, F.col(c)))
        out[name] = df
    return out


def links(pages: DataFrame, column: str = "body_text") -> DataFrame:
    """src_page_id, dst_title, dst_page_id of all [[title]] marks, each once; null where no page has the title."""
    marks = pages.select(F.col("id").alias("src_page_id"), F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(column, F.lit("")), F.lit(r"\[\[([^\[\]]{1,120})\]\]"), F.lit(1)), lambda m: F.trim(m)))).alias("dst_title"))
    known = pages.groupBy(F.lower("title").alias("_title")).agg(F.min("id").alias("dst_page_id"))
    return marks.join(known, F.lower("dst_title") == F.col("_title"), "left").select("src_page_id", "dst_title", "dst_page_id")


def backlinks(links_: DataFrame, pages: DataFrame) -> DataFrame:
    return links_.join(pages.select(F.col("id").alias("src_page_id"), "title"), "src_page_id").select(F.col("dst_page_id").alias("page_id"), "src_page_id", "title")


def add_tags(tags: DataFrame, fresh: DataFrame) -> DataFrame:
    return insert_missing(tags, fresh, "page_id", "name")


def renumber(pages: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """position counted anew, from 0, within groups."""
    return pages.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def merge_space(pages: DataFrame, tags: DataFrame, old: str, new: str) -> tuple[DataFrame, DataFrame]:
    """(pages, tags): the pages of a space go behind those of another, and get the old one's key as a tag."""
    moved = pages.where(F.col("space") == old)
    placed = pages.withColumn("_late", (F.col("space") == old).cast("int")).withColumn("space", F.when(F.col("space") == old, F.lit(new)).otherwise(F.col("space")))
    top = placed.where(F.col("parent_id").isNull() & (F.col("space") == new))
    order = top.withColumn("_at", F.row_number().over(Window.partitionBy("space").orderBy("_late", "position", "title")) - 1).select("id", "_at")
    out = placed.join(order, "id", "left").withColumn("position", F.coalesce("_at", "position"))
    return out.select(pages.columns), add_tags(tags, moved.select(F.col("id").alias("page_id"), F.lit(old).alias("name")))


def seed(pages: DataFrame, templates: DataFrame, at: str) -> DataFrame:
    """Templates (space, title, body_html, sensitivity) that are not there yet, by title."""
    missing = templates.join(pages.where("type = 'template'").select("title"), "title", "left_anti")
    return create(pages, missing.withColumn("type", F.lit("template")), at)


def set_setting(settings: DataFrame, key: str, value: str) -> DataFrame:
    return upsert(settings, settings.sparkSession.createDataFrame([(key, value)], "key string, value string"), "key")


def migrate(tables: dict[str, DataFrame], done: list[int], steps: dict[int, object]) -> tuple[dict[str, DataFrame], list[int]]:
    """Steps (number -> function of the tables) that were not taken, in order, each once."""
    for number in sorted(set(steps) - set(done)):
        tables = steps[number](tables)
        done = [*done, number]
    return tables, done
