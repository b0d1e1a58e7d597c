"""Tables of a data folder, and the small fixtures that queries and their SQL share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, as a URI; on one machine without that setting a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        app = spark.sparkContext.applicationId
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="corvana-")
            atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
        root = _OWN[app]
    root = root if "://" in root or root.startswith("file:") else f"file://{root}"
    return f"{root.rstrip('/')}/corvana-{uuid.uuid4().hex}"


def values(spark: SparkSession, sql_values: str, columns: str) -> DataFrame:
    """An inline table from the very literals that its SQL uses."""
    return spark.sql(f"SELECT * FROM VALUES {sql_values} AS t({columns})")


def spread(number: Column, templates: list[str | None]) -> Column:
    """One of some strings by a row's number, with the number for {n} in it: grammars over rows of a table."""
    one = F.element_at(F.array(*(F.lit(t).cast("string") for t in templates)), (F.pmod(number, F.lit(len(templates))) + 1).cast("int"))
    return F.replace(one, F.lit("{n}"), number.cast("string"))


def spread_sql(number: str, templates: list[str | None]) -> str:
    """The same in DuckDB."""
    listed = ", ".join("NULL" if t is None else "'" + t.replace("'", "''") + "'" for t in templates)
    return f"replace(([{listed}])[({number}) % {len(templates)} + 1], '{{n}}', ({number})::VARCHAR)"


def first_question(spark: SparkSession, sf_dir: str) -> str:
    """The text of the benchmark item with the smallest id: queries are scalars of a plan."""
    rows = table(spark, sf_dir, "benchmark").orderBy("item_id").limit(1).select("text").collect()
    return rows[0]["text"] if rows else ""


#: The first question's terms in DuckDB: term, place, times.
TERMS_SQL = """q AS (SELECT text FROM benchmark ORDER BY item_id LIMIT 1),
tok AS (SELECT regexp_extract_all(lower(text), '[A-Za-z0-9_''-]{3,}') AS w FROM q),
term AS (SELECT t AS term, min(p) AS place, count(*) AS times FROM (SELECT unnest(w) AS t, generate_subscripts(w, 1) AS p FROM tok) GROUP BY t),
numbered AS (SELECT term, times, row_number() OVER (ORDER BY place) AS n FROM term),
pair AS (SELECT a.term || ' ' || b.term AS pair FROM numbered a JOIN numbered b ON b.n = a.n + 1)"""


def score_sql(source: str, key: str, text: str, terms: str = "numbered", pairs: str = "pair") -> str:
    """CTEs toks, sat and scored(key, score) in DuckDB for the texts of a source."""
    return f"""toks AS (SELECT {key} AS k, regexp_extract_all(lower({text}), '[A-Za-z0-9_''-]{{3,}}') AS w FROM {source}),
tf AS (SELECT k, t AS term, count(*) AS n FROM (SELECT k, unnest(w) AS t FROM toks) GROUP BY k, t),
sat AS (SELECT tf.k, sum(CASE WHEN length(tf.term) >= 7 THEN 1.15 ELSE 1.0 END * (tf.n * 2.2::DOUBLE / (tf.n + 1.2::DOUBLE * (0.25 + 0.75::DOUBLE * len(toks.w) / 400))) * least(x.times, 2)) AS s
  FROM tf JOIN {terms} x USING (term) JOIN toks USING (k) GROUP BY tf.k),
bonus AS (SELECT k, 0.5 * (SELECT count(*) FROM {pairs} p WHERE contains(array_to_string(toks.w, ' '), p.pair)) AS b FROM toks),
scored AS (SELECT toks.k, CASE WHEN len(toks.w) = 0 THEN 0 ELSE CAST(round_even((coalesce(sat.s, 0) + bonus.b) * 10, 0) AS BIGINT) END AS score FROM toks JOIN bonus USING (k) LEFT JOIN sat USING (k))"""
