"""CSV folder -> the 15 logical model tables (survey S1-S3, P1-P4, N10).

Files are listed on the cluster file system (metadata only), each CSV is a
lazy, tolerant scan with every column read as text (no schema inference
pass); headers are normalised on the driver (they are names, not data);
logical names and the conditional renames follow fixed rule tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storeline.sources.split_csv import read_split

# ---- fixed values: file stem -> logical table ---------------------------------------------
TABLE_STEMS = {
    "menu": "menu", "outlet": "outlet", "outlet_menu": "outlet_menu", "daily_sales": "daily_sales",
    "order": "order", "review": "review", "food_quality": "food_quality", "transportation": "transportation",
    "customer_data": "customer", "promotion": "promotion", "employment": "employment",
    "emp_positon": "emp_position", "purchaseanalysis_15days": "purchase_15",
    "purchaseanalysis_month": "purchase_month", "purchaseanalysis": "purchase_week",
}
# ---- fixed values: conditional renames per table (source -> target, only when target absent)
RENAMES = {
    "menu": [("productid", "product_id"), ("product", "product_name")],
    "outlet_menu": [("id", "outlet_menu_id"), ("productid", "product_id"), ("outletid", "outlet_id")],
    "order": [("outlet_product_id_", "outlet_menu_id"), ("customer_id_", "customer_id"), ("quantity_", "quantity"),
              ("unitprice_", "unit_price"), ("date_", "date")],
    "review": [("outlet_product_id_", "outlet_menu_id"), ("reviewid", "review_id"), ("positive", "positive_score"),
               ("negative", "negative_score"), ("neutral", "neutral_score")],
    "transportation": [("price", "transportation_cost")],
    "employment": [("position", "position_id")],
}
# --------------------------------------------------------------------------------------------


def normalize_header(name: str) -> str:
    """Trim, lower, blanks / '-' / non-word characters -> '_' (Unicode word characters stay)."""
    n = name.strip().lower().replace(" ", "_").replace("-", "_")
    return re.sub(r"\W", "_", n)


def norm_columns(df: DataFrame) -> DataFrame:
    """P1 on a DataFrame (always, also for header-only files: N10)."""
    return df.toDF(*[normalize_header(c) for c in df.columns])


def list_csvs(spark: SparkSession, data_dir: str) -> dict[str, str]:
    """Top-level entries with a .csv suffix (any case), keyed by lower-case stem; last one wins.

    An entry is a file, or a folder of part files as Spark writes them."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(data_dir)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out: dict[str, str] = {}
    if not fs.exists(path):
        return out
    for st in sorted(fs.listStatus(path), key=lambda s: s.getPath().getName()):
        name = st.getPath().getName()
        if name.lower().endswith(".csv"):
            out[name[:-4].lower()] = st.getPath().toString()
    return out


def largest_file(spark: SparkSession, path: str) -> int:
    """Bytes of the largest file at ``path`` (a file, or a folder of files)."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return max((st.getLen() for st in fs.listStatus(where) if st.isFile()), default=0)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Tolerant scan -- header row, quoted multi-line fields, malformed rows kept as NULLs.

    Files of more than one split are read by ranges (``split_csv``), smaller ones by Spark's multi-line reader."""
    whole = (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
             .option("mode", "PERMISSIVE").option("inferSchema", False).csv(path))
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    if not whole.columns or largest_file(spark, path) <= split:
        return whole
    return read_split(spark, path, whole.columns)


def standard_renames(name: str, df: DataFrame) -> DataFrame:
    """Renames that apply only when the target column is absent."""
    for src, dst in RENAMES.get(name, []):
        if src in df.columns and dst not in df.columns:
            df = df.withColumnRenamed(src, dst)
    return df


def load_tables(spark: SparkSession, data_dir: str) -> dict[str, DataFrame]:
    """S3 + P2: the 15 logical tables; a missing table is an empty DataFrame."""
    files = list_csvs(spark, data_dir)
    empty = spark.createDataFrame([], "x string").select()
    out: dict[str, DataFrame] = {}
    for stem, logical in TABLE_STEMS.items():
        if stem in files:
            out[logical] = trimmed_ids(standard_renames(logical, norm_columns(read_csv(spark, files[stem]))))
        else:
            out.setdefault(logical, empty)
    return out


def trimmed_ids(df: DataFrame) -> DataFrame:
    """P4 for text input: keys stay text; an integral number written as '1.0' becomes '1' (N4)."""
    cols = {}
    for k in ("outlet_menu_id", "outlet_id", "product_id"):
        if k in df.columns:
            c = F.col(k)
            cols[k] = F.when(c.rlike(r"^\s*-?\d+\.0+\s*$"), F.regexp_replace(F.trim(c), r"\.0+$", "")).otherwise(c)
    return df.withColumns(cols) if cols else df
