"""Main text of web pages, with site templates removed."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.llm.common import stored
from wayline.llm.page_text import parse
from wayline.operators.skew import salted_join


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _rows(pages: DataFrame) -> DataFrame:
    """(row_key, page_id, url, host, html): rows that repeat share their key."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    source = F.coalesce(F.col("html"), F.lit(""))
    known = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in ("page_id", "url")]
    return pages.select(
        F.unhex(F.md5(F.concat_ws("|", *known, F.md5(source)))).alias("row_key"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), source.alias("html")
    )


def page_hashes(rows: DataFrame) -> DataFrame:
    """(row_key, host, content, hashes): a digest of each page's text as rules alone give it, and the hashes of its subtrees and slots."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content, hashes = [], []
            for source in batch.column("html"):
                page = parse(source.as_py())
                content.append(_signed(xxhash.xxh64_intdigest(page.text().encode("utf-8", "surrogatepass"))))
                hashes.append(sorted(map(_signed, page.hashes())))
            columns = [batch.column("row_key"), batch.column("host"), pa.array(content, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["row_key", "host", "content", "hashes"])

    return rows.select("row_key", "host", "html").mapInArrow(read, "row_key binary, host string, content long, hashes array<long>")


def _zipped(rows: DataFrame) -> DataFrame:
    """(row_key, page_id, url, zipped): pages compressed for the shuffle."""

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            zipped = pa.array([by.compress(source.as_py().encode("utf-8", "surrogatepass")) for source in batch.column("html")], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row_key", "page_id", "url")), zipped], ["row_key", "page_id", "url", "zipped"])

    return rows.select("row_key", "page_id", "url", "html").mapInArrow(squeeze, "row_key binary, page_id long, url string, zipped binary")


def _texts(rows: DataFrame) -> DataFrame:
    """(page_id, url, text) of (page_id, url, zipped, gone)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = zstandard.ZstdDecompressor()
        for batch in batches:
            gone = ({h & (2**64 - 1) for h in g or ()} for g in batch.column("gone").to_pylist())
            sources = (by.decompress(z.as_py()).decode("utf-8", "surrogatepass") for z in batch.column("zipped"))
            texts = [parse(source).text(g).encode("utf-8", "replace").decode() for source, g in zip(sources, gone)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return rows.select("page_id", "url", "zipped", "gone").mapInArrow(read, "page_id long, url string, text string")


def extract_text(pages: DataFrame, least_pages: int = 10, least_share: float = 0.05) -> DataFrame:
    r"""The main text of every page: its article without menus, headers, footers, sidebars, notices, adverts, forms,
    scripts, styles, markup and comments.

    Site templates go by count: every element subtree, of any size, is hashed from its children's hashes, and hashes are
    counted for each host over its different main texts; one that recurs on at least `least_pages` of them and
    `least_share` of the host's is deleted wherever it stands. Copies of a page count once, so a copied article is not
    taken for a template. What HTML itself keeps out of articles (nav, footer, aside, script, hidden elements) goes by
    rule. Names of classes and ids only hint: one that begins or ends with a word such as comments or sidebar drops its
    element unless that holds the page's article (or, without one, most of its words); other hints need the element's
    slot (tag, class and id) to recur over the host as a template does. References are decoded, white space in a block
    becomes one space, and blocks are joined by one \n in page order.

    Returns one row per row of `pages`: page_id, url, text, n_chars.

    Defined cases: a null or empty html gives the empty text; a null or odd url has the empty host; rows that repeat are
    extracted each; unclosed and misnested elements end where HTML ends them, and a tag whose quote stays open ends at
    the next >; a page whose article or main has less than two fifths of its words gives all blocks that stay; extra
    columns, whatever their names, are ignored; an empty table gives no rows.
    """
    rows = _rows(pages)
    # Hashes alone are stored; pages are parsed again below, which moves less than storing trees would.
    marks = stored(page_hashes(rows), "subtrees")
    different = marks.groupBy("host", "content").agg(F.min_by("hashes", "row_key").alias("hashes"))  # one page for each main text
    hosts = different.groupBy("host").agg(F.count("*").alias("pages"))
    counted = different.select("host", F.explode("hashes").alias("subtree")).groupBy("host", "subtree").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages)
    templates = stored(counted.join(hosts, "host").where(F.col("n") >= least_share * F.col("pages")).select("host", "subtree", "n"), "templates")
    standing = marks.select("row_key", "host", F.explode("hashes").alias("subtree"))
    total = templates.agg(F.sum("n")).first()[0] or 0
    hits = salted_join(standing, templates, ["host", "subtree"], "n", total, F.col("row_key")).groupBy("row_key").agg(F.collect_set("subtree").alias("gone"))
    texts = _texts(_zipped(rows).join(hits, "row_key", "left"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))
