"""Schema resolution and cleaning.

Resolution happens on the driver over ``df.columns`` (metadata only); the
cleaning itself is one select/filter chain with no shuffle.
"""

from __future__ import annotations

import json
import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from starlens.functions.labels import label_name, star_label
from starlens.functions.text import coerce_rating, compose_text, fill_text

# Candidate column names, first present wins.
RATING_CANDIDATES = ["reviews.rating", "rating", "reviews.rating.value", "review_rating", "stars"]
TEXT_CANDIDATES = ["reviews.text", "review_text", "text", "reviews", "body"]
TITLE_CANDIDATES = ["reviews.title", "review_title", "title", "summary"]
PRODUCT_CANDIDATES = ["name", "product.name", "products.name", "asins", "id"]
DASH_RATING_CANDIDATES = ["reviews.rating_x", "reviews.rating", "rating"]
DASH_TEXT_CANDIDATES = ["reviews.text", "text", "full_review"]
DASH_USER_CANDIDATES = ["reviews.username", "username", "user"]
DASH_SENTIMENT_CANDIDATES = ["pred_label_name", "vader_label_name", "sentiment"]


def q(name: str) -> str:
    """Backtick-quote a column name (dotted names such as ``reviews.rating``)."""
    return "`" + name.replace("`", "``") + "`"


def resolve_column(df: DataFrame, candidates: list[str]) -> str | None:
    """B1: first candidate present in ``df`` (this frame, not a global)."""
    cols = set(df.columns)
    return next((c for c in candidates if c in cols), None)


def require_columns(**resolved: str | None) -> None:
    """B2: fail before planning when a required role is unresolved."""
    missing = [role for role, col in resolved.items() if col is None]
    if missing:
        raise ValueError(f"Could not detect required columns: {', '.join(missing)}")


def trim_column_names(df: DataFrame) -> DataFrame:
    """Strip header whitespace."""
    return df.toDF(*[c.strip() for c in df.columns])


def drop_short(df: DataFrame, text: str = "text", min_len: int = 5) -> DataFrame:
    """Drop null rating/text, keep texts longer than ``min_len`` chars."""
    return (df.filter(F.col("rating").isNotNull() & F.col(text).isNotNull())
              .filter(F.length(text) > min_len))


def valid_rating(df: DataFrame, lo: int = 1, hi: int = 5, col: str = "rating") -> DataFrame:
    """Truncate to int, keep lo..hi. Filtering [lo, hi+1) first gives the
    same rows and keeps the int cast from overflowing on huge values."""
    r = F.col(col)
    return df.filter((r >= lo) & (r < hi + 1)).withColumn(col, r.cast("int"))


def clean_reviews(df: DataFrame, key: str | None = "review_id", min_len: int = 5) -> DataFrame:
    """Resolve columns, coerce the rating, fill and compose text, drop
    short or unrated rows, keep ratings 1..5; add the star label (C1/C2)."""
    rating_col = resolve_column(df, RATING_CANDIDATES)
    text_col = resolve_column(df, TEXT_CANDIDATES)
    require_columns(rating=rating_col, text=text_col)
    title_col = resolve_column(df, TITLE_CANDIDATES)
    product_col = resolve_column(df, PRODUCT_CANDIDATES)
    keep = [F.col(q(c)) for c in df.columns if c in (key, "cluster_name")]
    title = fill_text(F.col(q(title_col)) if title_col else None, "")
    body = fill_text(F.col(q(text_col)), "")
    out = df.select(
        *keep,
        coerce_rating(F.col(q(rating_col))).alias("rating"),
        title.alias("review_title"),
        body.alias("review_body"),
        fill_text(F.col(q(product_col)) if product_col else None, "Unknown").alias("product"),
    ).withColumn("text", compose_text(F.col("review_title"), F.col("review_body")))
    out = out.withColumn("name", F.col("product"))
    out = valid_rating(drop_short(out, min_len=min_len))
    return (out.withColumn("star_label", star_label("rating"))
               .withColumn("star_label_name", label_name("star_label")))


#: Rows and characters up to which an alias table is a literal of the plan.
MAX_ALIASES, MAX_ALIAS_CHARS = 20_000, 1_000_000


def _char_class(chars) -> str:
    """Java regex class of code points, runs of them as ranges."""
    points, parts = sorted(map(ord, chars)), []
    for cp in points:
        if parts and parts[-1][1] == cp - 1:
            parts[-1][1] = cp
        else:
            parts.append([cp, cp])
    return "[" + "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in parts) + "]"


def _longest_pattern(words) -> str:
    """Java regex that matches the longest of ``words``: a trie, where what may
    follow a word is optional and tried first."""
    trie: dict = {}
    for w in words:
        node = trie
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def spell(node):
        leaves = [c for c, n in node.items() if c and set(n) == {""}]
        ways = [_char_class(leaves)] if leaves else []
        ways += [_char_class(c) + spell(n) for c, n in sorted(node.items()) if c and set(n) != {""}]
        return "" if not ways else f"(?:{'|'.join(ways)})" + ("?" if "" in node else "")

    return f"(?={_char_class([c for c in trie])})" + spell(trie)


def emoji_to_text(df: DataFrame, aliases: DataFrame, text: str = "text") -> DataFrame:
    """Replace every emoji of the alias table (emoji, alias) by its alias.

    Left to right, the longest emoji that starts at a place wins (a skin tone
    or a joined sequence is not taken apart by a shorter one), and alias texts
    are not read again. The table becomes literals of the plan: a trie as one
    pattern, which cuts a text into pieces and matches, and the aliases in slots
    by CRC-32, so a match finds its alias at once; all within the row. An emoji
    listed twice has its least alias; empty emoji do not count, a null alias is
    an empty one. Beyond ``MAX_ALIASES`` or ``MAX_ALIAS_CHARS`` the table is refused."""
    rows = (aliases.select(F.col("emoji").cast("string"), F.coalesce(F.col("alias").cast("string"), F.lit("")).alias("alias"))
                   .filter("emoji is not null and emoji != ''").groupBy("emoji").agg(F.min("alias").alias("alias"))
                   .limit(MAX_ALIASES + 1).collect())
    if len(rows) > MAX_ALIASES or sum(len(r.emoji) + len(r.alias) for r in rows) > MAX_ALIAS_CHARS:
        raise ValueError("the alias table is too large for a literal")
    if not rows:
        return df
    slots: list[dict] = [{} for _ in range(max(1, len(rows) // 2))]
    for r in rows:
        slots[zlib.crc32(r.emoji.encode()) % len(slots)][r.emoji] = r.alias
    table = F.from_json(F.lit(json.dumps(slots, ensure_ascii=False)), "array<map<string,string>>")
    pattern = F.lit(_longest_pattern([r.emoji for r in rows]))
    found = F.regexp_extract_all(F.col(text), pattern, F.lit(0))
    out = df.withColumn("__found", found)
    pieces = F.split(F.col(text), pattern)
    each = F.zip_with(pieces, "__found", lambda p, m: F.concat(p, F.coalesce(
        F.try_element_at(F.get(table, F.pmod(F.crc32(m), F.lit(len(slots)))), m), F.lit(""))))
    changed = F.when(F.size("__found") > 0, F.array_join(each, "")).otherwise(F.col(text))
    return out.withColumn(text, changed).drop("__found")


def normalized_text(col) -> "F.Column":
    """Lower-case, punctuation removed, whitespace collapsed and stripped."""
    c = F.lower(col)
    c = F.regexp_replace(c, r"[\p{P}\p{S}]", "")
    c = F.regexp_replace(c, r"\s+", " ")
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def near_dedup(df: DataFrame, text: str = "text", key: str = "review_id") -> DataFrame:
    """Keep one row per MD5 of the normalised text: the one of lowest key
    (rows without key last); among rows of one key that of the lowest hash of
    the whole row, so repeated rows leave exactly one.

    A text that normalises to nothing (marks or emoji only) is compared as it
    is; rows without text have no fingerprint and all stay. A row stays or goes
    by its own rank, never by its key. The rank's limit of 1 works before the
    shuffle too, so a partition sends one row per fingerprint and a hot one
    meets as many rows as there are partitions."""
    plain = normalized_text(F.col(text))
    fp = F.md5(F.when(plain == "", F.concat(F.lit("\u0000"), F.col(text))).otherwise(plain))
    own = F.concat(F.lit("row "), F.monotonically_increasing_id().cast("string"))
    whole = F.xxhash64(*[F.col(q(f.name)) for f in df.schema if not isinstance(f.dataType, (MapType, VariantType))])
    rank = F.row_number().over(Window.partitionBy("__fp").orderBy(F.col(key).asc_nulls_last(), "__whole"))
    return (df.withColumns({"__fp": F.coalesce(fp, own), "__whole": whole})
              .withColumn("__rank", rank).filter("__rank <= 1").drop("__fp", "__whole", "__rank"))


def select_existing(df: DataFrame, cols: list[str | None], rename: dict[str, str] | None = None,
                    cap: int | None = None, order_by: list[str] | None = None) -> DataFrame:
    """Project the columns that exist, rename, show at most ``cap`` rows
    (in ``order_by`` order when given)."""
    present = [c for c in cols if c and c in df.columns]
    out = df.select(*[F.col(q(c)).alias((rename or {}).get(c, c)) for c in present])
    if order_by:
        out = out.orderBy(*order_by)
    return out.limit(cap) if cap else out
