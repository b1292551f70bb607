"""CSV folder loading (S1-S3, P1-P4): reference-style headers give the same masters as the parquet path."""

import glob
import math
import shutil

from storeline.operators import masters
from storeline.sources.csv_tables import load_tables, normalize_header
from storeline.sources.fixtures import model_tables

from conftest import SF_SMALL


def test_normalize_header():
    assert normalize_header(" Outlet_Product(ID)") == "outlet_product_id_"
    assert normalize_header("Unit Price") == "unit_price"
    assert normalize_header("a-b") == "a_b"
    assert normalize_header("prix é") == "prix_é"


def _write_csv(df, folder, stem, rename):
    for a, b in rename.items():
        df = df.withColumnRenamed(a, b)
    out = f"{folder}/_{stem}"
    df.coalesce(1).write.option("header", True).csv(out)
    part = glob.glob(f"{out}/part-*.csv")[0]
    shutil.copy(part, f"{folder}/{stem}")


def test_csv_folder_matches_parquet(spark, tmp_path):
    t = model_tables(spark, SF_SMALL)
    folder = str(tmp_path)
    layout = {
        "outlet": ("Outlet.csv", {"outlet_id": "Outlet ID"}),
        "menu": ("menu.CSV", {"product_id": "ProductID", "product_name": "Product"}),
        "outlet_menu": ("outlet_menu.csv", {"outlet_menu_id": "ID", "product_id": "ProductID", "outlet_id": "OutletID"}),
        "order": ("order.csv", {"outlet_menu_id": " Outlet_Product(ID)", "customer_id": "Customer_ID(",
                                "quantity": "Quantity(", "unit_price": "Unit Price", "date": "Date "}),
        "daily_sales": ("daily_sales.csv", {}),
        "review": ("review.csv", {"outlet_menu_id": "Outlet_Product_ID_", "positive_score": "Positive",
                                  "negative_score": "Negative", "neutral_score": "Neutral"}),
        "food_quality": ("food_quality.csv", {}),
        "transportation": ("transportation.csv", {"transportation_cost": "Price"}),
        "promotion": ("promotion.csv", {}),
        "employment": ("employment.csv", {"position_id": "Position"}),
    }
    for name, (fname, rename) in layout.items():
        _write_csv(t[name], folder, fname, rename)
    loaded = load_tables(spark, folder)
    assert set(loaded["order"].columns) >= {"outlet_menu_id", "customer_id", "quantity", "unit_price", "date"}
    assert "customer" in loaded and loaded["customer"].columns == []
    a = {r.outlet_id: r for r in masters.master_outlet(loaded).collect()}
    b = {r.outlet_id: r for r in masters.master_outlet(t).collect()}
    assert a.keys() == b.keys()
    for k in b:
        for col, v in b[k].asDict().items():
            w = a[k][col]
            if isinstance(v, float):
                assert math.isclose(w, v, rel_tol=1e-9, abs_tol=1e-9), (k, col, w, v)
            else:
                assert w == v, (k, col, w, v)
