import zipfile
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerloom.sources import files as S, sinks as W

XML = ('<?xml version="1.0" encoding="UTF-8"?><cfdi:Comprobante xmlns:cfdi="http://www.sat.gob.mx/cfd/{v}" Version="{ver}" Serie="A" Folio="{n}" Fecha="2024-05-06T10:00:00" Moneda="USD" TipoCambio="17.5" '
       'Total="{t}" TipoDeComprobante="{k}"><cfdi:Complemento><tfd:TimbreFiscalDigital xmlns:tfd="http://www.sat.gob.mx/TimbreFiscalDigital" UUID="u{n}"/></cfdi:Complemento></cfdi:Comprobante>')


def test_loose_and_zipped_invoices(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML.format(v=3, ver="3.3", n=1, t="100.00", k="I"))
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("x/b.xml", XML.format(v=4, ver="4.0", n=2, t="40.00", k="E"))
        z.writestr("x/c.xml", XML.format(v=4, ver="4.0", n=3, t="9.00", k="P"))
    inv = S.invoices_from_xml(S.xml_files(spark, str(tmp_path)))
    booked, skipped = S.normalise_invoices(inv)
    assert {(r.folio, r.version, r.uuid, r.amount) for r in booked.collect()} == {("1", "3.3", "u1", Decimal("1750.00")), ("2", "4.0", "u2", Decimal("-700.00"))}
    assert [r.folio for r in skipped.collect()] == ["3"]


def test_latin1_and_bad_rows(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes("id,name\n1,Peñón\nx,abc\n".encode("latin-1"))
    rows = S.read_flat(spark, str(tmp_path / "x.csv"), "id int, name string", "ISO-8859-1").cache().collect()
    assert rows[0]["name"] == "Peñón" and rows[0]["_bad"] is None and rows[1]["_bad"] is not None


def test_rates_fall_back_and_carry_on(spark):
    mk = lambda rows: spark.createDataFrame(rows, "day string, rate string").select(F.col("day").cast("date").alias("day"), F.col("rate").cast("decimal(10,4)").alias("rate"))
    r = S.first_available([mk([("2024-01-01", "1")]), mk([("2024-01-01", "2"), ("2024-01-03", "3")])], ["day"])
    assert {str(x.day): (float(x.rate), x.source_rank) for x in r.collect()} == {"2024-01-01": (1.0, 0), "2024-01-03": (3.0, 1)}
    days = mk([("2024-01-02", "0"), ("2024-01-03", "0"), ("2023-12-31", "0")]).select("day")
    assert {str(x.day): x.rate and float(x.rate) for x in S.last_known(days, r).collect()} == {"2023-12-31": None, "2024-01-02": 1.0, "2024-01-03": 3.0}


def test_export_writes_ddl_and_manifest(spark, tmp_path):
    df = spark.createDataFrame([(1, Decimal("1.50"), ["a"])], "customer_id long, price decimal(12,2), tags array<string>")
    m = W.export({"t": (df, "a test")}, str(tmp_path)).first()
    assert (m.table_name, m.rows, m.customer_columns) == ("t", 1, "customer_id")
    text = spark.read.json(f"{tmp_path}/ddl").first().ddl
    assert "`price` decimal(12,2)" in text and "`tags` array<string>" in text


def test_daily_log_rerun_replaces_all_days_of_its_range(spark, tmp_path):
    log = str(tmp_path / "log")
    df = spark.createDataFrame([("2024-01-01", 1), ("2024-01-02", 2), ("2024-01-03", 3)], "sent string, v int")
    W.write_daily(df, log)
    W.write_daily(df.filter("v = 2"), log, "2024-01-02", "2024-01-03")  # the third has no row any more
    assert sorted(r.v for r in W.read_daily(spark, log).collect()) == [1, 2]
    W.write_daily(df.filter("v = 3"), log, "2024-01-03", "2024-01-03")
    assert sorted(r.v for r in W.read_daily(spark, log).collect()) == [1, 2, 3]


def test_findings_are_in_order_of_severity(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "low"), (2, "b", "critical"), (3, "c", "medium"), (4, "d", "odd"), (5, "e", "high")], "page_id int, finding string, severity string")
    W.write_findings(df, str(tmp_path / "f"))
    lines = [x for p in sorted((tmp_path / "f").glob("part-*")) for x in p.read_text().splitlines()]
    assert [x.split('"severity":"')[1].split('"')[0] for x in lines] == ["critical", "high", "medium", "low", "odd"]


def test_confirmed_taps_by_another_clock(spark, tmp_path):
    from ledgerloom.sources.readings import confirmed_taps
    (tmp_path / "full.csv").write_text("t_inicio, km,caudal,descripcion\n2024-01-01 00:00:00,47.3,18.5,valve\n2024-01-01 00:00:00,47.3,18.5,valve\nnever,1,2,x\n2024-01-02 06:00:00,,1,y\n")
    (tmp_path / "short.csv").write_text("km,t_inicio\n3,2024-01-01 01:00:00\n")
    first = spark.sql("SELECT unix_micros(TIMESTAMP '2024-01-01 06:00:00 UTC')").first()[0]
    assert [tuple(r)[1:] for r in confirmed_taps(spark, str(tmp_path / "full.csv"), -6).collect()] == [(first, 47.3, 18.5, "valve")]
    assert [tuple(r)[1:] for r in confirmed_taps(spark, str(tmp_path / "short.csv"), -5).collect()] == [(first, 3.0, None, None)]


def test_archives_come_back_as_they_went(spark):
    from ledgerloom.sources import files as S
    e = spark.createDataFrame([("a", "1.xml", "<x>é</x>"), ("a", "2.XML", "<y/>"), ("a", "note.txt", "no"), ("b", "1.xml", "")], "archive string, name string, text string")
    loose = spark.createDataFrame([("3.xml", bytearray(b"<z/>"))], "path string, content binary")
    got = S.unpacked(S.archives(e, "archive").unionByName(loose)).collect()
    assert sorted(map(tuple, got)) == [("3.xml", "<z/>"), ("a.zip!1.xml", "<x>é</x>"), ("a.zip!2.XML", "<y/>"), ("b.zip!1.xml", "")]


def test_archives_are_unpacked_by_size(monkeypatch):
    """However many archives come in a batch, a task holds few of their texts at a time."""
    import io
    import zipfile

    import pandas as pd
    from ledgerloom.sources import files

    monkeypatch.setattr(files, "UNPACKED", 5_000, raising=False)
    content = io.BytesIO()
    with zipfile.ZipFile(content, "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(30):
            z.writestr(f"{i}.xml", f"{i:1000d}")
    batch = pd.DataFrame({"path": ["a.zip", "b.zip", "c.xml"], "content": [content.getvalue(), content.getvalue(), b"<x/>"]})
    parts = list(files._unpack(iter([batch])))
    assert max(p["xml"].str.len().sum() for p in parts) <= 6_000
    assert sum(map(len, parts)) == 61 and pd.concat(parts)["path"].is_unique
