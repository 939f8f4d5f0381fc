import duckdb

from plumbline.plans import drawings

SF = "/root/testdata/sf0.001"


def test_turned_inserts_open_into_the_room_they_face(spark):
    got = sorted(map(tuple, drawings.turned_inserts(spark, SF).collect()), key=repr)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW part AS SELECT * FROM '{SF}/part.parquet'")
    want = sorted(db.execute(drawings.ORACLE["turned_inserts"]).fetchall(), key=repr)
    assert got == want
    assert {r[2] for r in got} == {0.0, 90.0, 180.0, 270.0}
    assert 0 < sum(r[5] is None for r in got) < len(got)
