from cardwarden.session import parts_of


def test_parts_of_a_join_are_those_of_both_sides(spark, tmp_path):
    for name in ("a", "b"):
        spark.range(200_000).selectExpr("id", f"uuid() as {name}").write.parquet(str(tmp_path / name))
    a, b = (spark.read.parquet(str(tmp_path / name)) for name in ("a", "b"))
    bytes_of = {name: sum(f.stat().st_size for f in (tmp_path / name).glob("*.parquet")) for name in ("a", "b")}
    assert parts_of(a, 1 << 20) == -(-bytes_of["a"] // (1 << 20))
    both = parts_of(a.join(b, "id"), 1 << 20)
    assert both == -(-sum(bytes_of.values()) // (1 << 20)), both
    assert parts_of(a.join(b, "id")) < 4
