import os
import tempfile

from shopgroups.operators import baskets as B
from shopgroups.sources import io as IO


def test_read_raw_files_and_round_trip(spark):
    folder = tempfile.mkdtemp(prefix="shopgroups-test-io-")  # tests only
    basket_csv = os.path.join(folder, "customer_basket.csv")
    with open(basket_csv, "w") as fh:
        fh.write('customer_id,invoice_id,list_of_goods\n')
        fh.write('1,10,"[\'asparagus\', \'airpods\', \'asparagus\']"\n')
        fh.write('2,11,[]\n')
    baskets = IO.read_customer_basket(spark, basket_csv)
    got = {r.invoice_id: (r.customer_id, r.basket_size, r.distinct_products_per_basket) for r in baskets.collect()}
    assert got == {10: (1, 3, 2), 11: (2, 0, 0)}
    lines = B.explode_items(baskets)
    assert lines.count() == 3

    info_csv = os.path.join(folder, "customer_info.csv")
    cols = [f.strip().split(" ")[0] for f in IO.CUSTOMER_INFO_SCHEMA.split(",")]
    with open(info_csv, "w") as fh:
        fh.write(",".join(reversed(cols)) + "\n")  # column order differs from the schema
        values = {c: "" for c in cols}
        values.update(customer_id="7", customer_name="Msc. Ann", kids_home="NaN", typical_hour="9")
        fh.write(",".join(values[c] for c in reversed(cols)) + "\n")
    info = IO.read_customer_info(spark, info_csv).first()
    assert info.customer_id == 7 and info.customer_name == "Msc. Ann"
    assert info.kids_home is None and info.typical_hour == 9.0

    out = IO.round_trip_check(spark, baskets.select("invoice_id", "customer_id"), os.path.join(folder, "rt"), "csv")
    assert dict((r.check, r.value) for r in out.collect())["rows read"] == "2"
