"""Quoted line breaks, files with headers of their own, and the keyed state behind uploads."""

import csv
import io
import random

import pytest

from foresail.operators.series import monthly_revenue
from foresail.schema import LEAD_COLUMNS
from foresail.sources import csv_records
from foresail.sources.csv_leads import read_leads_csv
from foresail.sources.csv_records import named_cells, placed_lines
from foresail.streaming.state import KeyedState
from foresail.streaming.uploads import append_uploads, current_leads, current_revenue, lead_state

PIECES = ["a", "b c", '"', '""', ",", "\n", "x\ny", '",', '"\n"', "", " ", '5"', "é"]


def _cell(rng):
    return "".join(rng.choice(PIECES) for _ in range(rng.randrange(4)))


def _table(rng, rows, width):
    """Random cells; blank lines and comments inside cells would be dropped, so none are made."""
    out = []
    for k in range(rows):
        cells = [_cell(rng).replace("\n\n", "\n").strip("\n #") for _ in range(width - 1)]
        cells = ["\n".join(x for x in c.split("\n") if x.strip()) for c in cells]
        out.append([f"r{k}", *cells])
    return out


@pytest.mark.parametrize("block", ["150", "10m"])
def test_records_equal_the_csv_module(spark, tmp_path, block):
    rng = random.Random(block)
    expect = []
    for k in range(4):
        names = ["id", "one", "two", "three"]
        rng.shuffle(names)
        rows = _table(rng, rng.randrange(1, 25), 4)
        text = io.StringIO()
        out = csv.writer(text, lineterminator="\n", quoting=rng.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL]))
        out.writerow(names)
        for row in rows:
            cells = dict(zip(["id", "one", "two", "three"], row))
            out.writerow([cells[n] for n in names])
            expect.append((f"f{k}", *(cells[n] or None for n in ("id", "one", "two", "three"))))
        (tmp_path / f"f{k}.csv").write_text(text.getvalue())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        lines = placed_lines(spark.read.text(str(tmp_path)))
        got = named_cells(lines, ["id", "one", "two", "three"], ["id"], ["file"]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    # cells are compared without outer spaces, and empty ones as absent
    clean = lambda row: tuple((c or "").strip() for c in row)
    assert sorted(clean((r.file.rsplit("/", 1)[1][:-4], r.id, r.one, r.two, r.three)) for r in got) == sorted(map(clean, expect))


@pytest.mark.parametrize("bits", [0, 1, 3])
def test_a_block_is_put_in_order_chunk_by_chunk(spark, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(csv_records, "CHUNK_BITS", bits)
    rows = [["id", "one"], *([f"r{k}", ("a\n" * (k % 7)) + 'b "c", d'[: k % 9]] for k in range(40))]
    text = io.StringIO()
    csv.writer(text, lineterminator="\n").writerows(rows)
    (tmp_path / "a.csv").write_text(text.getvalue())
    lines = placed_lines(spark.read.text(str(tmp_path)))
    assert csv_records.chunk_maps(lines).count() == (text.getvalue().count("\n") + (1 << bits) - 1) >> bits
    got = named_cells(lines, ["id", "one"], ["id"])
    assert sorted((r.id, r.one or "") for r in got.collect()) == sorted((k, v) for k, v in rows[1:])


def test_a_record_is_cut_once(spark, tmp_path):
    """A filter on the leads read does not move the parser, or the cells' types, into a condition of its own."""
    _file(tmp_path / "a.csv", [_lead("A", destination="New\nYork"), _lead("B")])
    read = read_leads_csv(spark, str(tmp_path))
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert sum(line.count("from_csv") for line in plan.splitlines() if "header#" not in line) == 1
    assert not any("gettimestamp" in line or "from_csv" in line for line in plan.splitlines() if "Filter" in line or "Join" in line)


HEADER = ",".join(LEAD_COLUMNS)


def _lead(ident, **cells):
    row = dict.fromkeys(LEAD_COLUMNS, "") | {"lead_id": ident, "inquiry_date": "2023-01-15", "trip_price": "100", "current_stage": "completed",
                                             "trip_date": "2023-07-15", "booking_date": "2023-02-01"} | cells
    return row


def _file(path, rows, order=LEAD_COLUMNS):
    text = io.StringIO()
    out = csv.DictWriter(text, order, lineterminator="\n")
    out.writeheader()
    out.writerows(rows)
    path.write_text(text.getvalue())


def test_a_quoted_cell_spans_lines(spark, tmp_path):
    _file(tmp_path / "a.csv", [_lead("A", destination="New\nYork"), _lead("B", destination='say "hi",\nplease')])
    _file(tmp_path / "b.csv", [_lead("C", destination="Oslo, Bergen")], LEAD_COLUMNS[::-1])
    got = {r.lead_id: r.destination for r in read_leads_csv(spark, str(tmp_path)).collect()}
    assert got == {"A": "New\nYork", "B": 'say "hi",\nplease', "C": "Oslo, Bergen"}


def test_a_quote_inside_a_plain_cell_opens_nothing(spark, tmp_path):
    (tmp_path / "a.csv").write_text(f'{HEADER}\nA,2023-01-15,5" pipe,1,,lost,,,,,,\nB,2023-01-15,x,2,,lost,,,,,,\n')
    assert {r.lead_id: r.destination for r in read_leads_csv(spark, str(tmp_path)).collect()} == {"A": '5" pipe', "B": "x"}


def test_a_file_that_ends_inside_quotes_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text(f'{HEADER}\nA,2023-01-15,"open,1,,lost,,,,,,\nB,2023-01-15,x,2,,lost,,,,,,\n')
    with pytest.raises(ValueError, match="a.csv ends inside a quoted cell"):
        read_leads_csv(spark, str(tmp_path)).collect()


def test_a_header_may_span_lines_and_lack_columns(spark, tmp_path):
    order = ["note\nof two lines", *[c for c in LEAD_COLUMNS if c != "duration_days"]]
    _file(tmp_path / "a.csv", [{k: v for k, v in (_lead("A") | {"note\nof two lines": "n"}).items() if k in order}], order)
    row = read_leads_csv(spark, str(tmp_path)).first()
    assert row.lead_id == "A" and row.duration_days is None and row.trip_price == 100.0
    (tmp_path / "b.csv").write_text("lead_id,trip_price\nB,1\n")
    with pytest.raises(ValueError, match="booking_date.*b.csv"):
        read_leads_csv(spark, str(tmp_path))


def test_only_comments_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("# nothing\n\n,,,\n")
    with pytest.raises(ValueError, match="no data lines"):
        read_leads_csv(spark, str(tmp_path))


def test_permuted_and_repeated_uploads_equal_batch(spark, tmp_path):
    landing, state, checkpoint = tmp_path / "in", str(tmp_path / "state"), str(tmp_path / "checkpoint")
    landing.mkdir()
    first = [_lead(f"L{k}", destination="New\nYork" if k % 3 else "Oslo", trip_price=str(k)) for k in range(30)] + [_lead("", trip_price="7")]
    _file(landing / "u_20240101_000000.csv", first)
    append_uploads(spark, str(landing), state, checkpoint, buckets=8)
    second = [_lead(f"L{k}", destination="Rome", trip_price="1000") for k in range(5)] + [_lead("new", trip_price="3", destination="Oslo")]
    _file(landing / "u_20240301_000000.csv", second, LEAD_COLUMNS[::-1])
    _file(landing / "u_20240201_000000.csv", [_lead("L0", trip_price="-1"), _lead("L9", trip_price="90")], sorted(LEAD_COLUMNS))
    _file(landing / "u_20240302_000000.csv", second, LEAD_COLUMNS[::-1])
    append_uploads(spark, str(landing), state, checkpoint, max_files=1)
    current = {r["lead_id"]: r for r in first if r["lead_id"]} | {"L9": _lead("L9", trip_price="90")} | {r["lead_id"]: r for r in second}
    _file(tmp_path / "batch.csv", [*current.values(), first[-1]])
    batch = read_leads_csv(spark, str(tmp_path / "batch.csv"))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(current_leads(spark, state).collect(), key=key) == sorted(batch.collect(), key=key)
    for keys in ((), ("destination",), ("destination", "lead_source")):
        for as_of in (None, "2023-01-01", "2024-01-01"):
            assert sorted(current_revenue(spark, state, keys, as_of).collect(), key=key) == sorted(monthly_revenue(batch, keys, as_of).collect(), key=key)
    with pytest.raises(ValueError, match="current_stage"):
        current_revenue(spark, state, ["current_stage"])


def test_before_any_upload_there_is_nothing(spark, tmp_path):
    assert current_leads(spark, str(tmp_path / "none")).count() == 0
    assert current_revenue(spark, str(tmp_path / "none"), ["destination"]).count() == 0


def test_a_file_without_a_time_stamp_fails(spark, tmp_path):
    (tmp_path / "in").mkdir()
    _file(tmp_path / "in" / "upload.csv", [_lead("A")])
    with pytest.raises(Exception, match="no time stamp"):
        append_uploads(spark, str(tmp_path / "in"), str(tmp_path / "state"), str(tmp_path / "checkpoint"))


def _state(spark, root, **more):
    from pyspark.sql import functions as F
    return KeyedState(spark, root, "k", lambda rest: F.max(F.struct(*rest)), {"sums": lambda rows: rows.groupBy("bucket").agg(F.sum("v").alias("v"))}, **more)


def test_a_batch_rewrites_only_its_buckets_and_repeats_safely(spark, tmp_path):
    root = str(tmp_path / "s")
    state = _state(spark, root, buckets=16)
    frame = lambda rows: spark.createDataFrame(rows, "k long, at int, v long")
    state.merge(frame([(k, 0, k) for k in range(100)]), 0)
    old = state.table()
    state.merge(frame([(3, 1, 50), (None, 1, 9)]), 1)
    written = {p.name for p in (tmp_path / "s" / "rows" / "version=1").glob("bucket=*")}
    assert len(written) == 1
    assert old.filter("k = 3").first().v == 3        # a reader of the list before sees what was there
    for _ in range(2):
        assert sorted((r.k is None, r.k, r.v) for r in state.table().collect()) == sorted([(False, k, 50 if k == 3 else k) for k in range(100)] + [(True, None, 9)], key=lambda r: (r[0], r[1] or 0))
        assert sum(r.v for r in state.table("sums").collect()) == sum(range(100)) + 47 + 9
        _state(spark, root, buckets=4).merge(frame([(3, 1, 50), (None, 1, 9)]), 1)  # again, after a lost driver


def test_a_batch_without_its_list_is_not_seen(spark, tmp_path):
    root = str(tmp_path / "s")
    state = _state(spark, root, buckets=4)
    state.merge(spark.createDataFrame([(1, 0, 1)], "k long, at int, v long"), 0)
    rows = spark.createDataFrame([(1, 5, 7, 0)], "k long, at int, v long, bucket int")
    state._write("rows", rows, 1)  # a batch that died before its list was written
    assert [r.v for r in state.table().collect()] == [1]
    assert lead_state(spark, str(tmp_path / "t")).table() is None
