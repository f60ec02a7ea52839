"""CSV records that fit their header or not, against Python's reader and by hand."""

import csv
import io
import random

import pytest

from visitflow.sources.records import bad_record_counts
from visitflow.sources.tables import read_sessions_csv, split_sessions_csv

HEADER = "visitId,a,b\n"


def split(spark, path, **options):
    good, bad = split_sessions_csv(spark, str(path), **options)
    return sorted(map(tuple, good.collect()), key=str), sorted((r["record"], r["reason"]) for r in bad.collect())


@pytest.mark.parametrize(
    ("record", "reason"),
    [
        ("1,2,3,4", "too many fields"),
        ('1,"2,",3,"4"', "too many fields"),
        ("1,2", "too few fields"),
        ("1", "too few fields"),
        ('1,"2,3', "open quote"),
        ('1,2,"3""', "open quote"),
        ('1,"2"x,3', "text behind a quote"),
    ],
)
def test_bad_records(spark, tmp_path, record, reason):
    (tmp_path / "t.csv").write_text(f"{HEADER}7,x,y\n{record}\n8,,\n")
    good, bad = split(spark, tmp_path / "t.csv")
    assert good == [("7", "x", "y"), ("8", None, None)]
    assert bad == [(record, reason)]
    for columns in (["a"], ["visitId", "a", "b"]):
        with pytest.raises(Exception, match=f"(?s){reason}, in .*t.csv: .*multi_line"):
            read_sessions_csv(spark, str(tmp_path / "t.csv")).select(*columns).collect()
    with pytest.raises(Exception, match=reason):
        read_sessions_csv(spark, str(tmp_path / "t.csv")).count()


def test_good_records_as_python_reads_them(spark, tmp_path):
    draw = random.Random(2)
    cells = ["", "x", 'q"q', 'in, side', '""', "8\"", "'", " a ", "\\", "é\\\"", "x" * 3000 + '"' * 5000]
    rows = [[str(i), draw.choice(cells), draw.choice(cells)] for i in range(300)]
    text = io.StringIO()
    csv.writer(text, lineterminator="\n").writerows(rows)
    lines = text.getvalue() + '900,8" inch,a"b"c\n\n901, "x",y\n'
    (tmp_path / "t.csv").write_text(HEADER + lines)
    expected = [tuple(c or None for c in r) for r in csv.reader(io.StringIO(lines)) if r]
    good, bad = split(spark, tmp_path / "t.csv")
    assert (good, bad) == (sorted(expected, key=str), [])


def test_line_breaks_in_cells(spark, tmp_path):
    text = HEADER + '1,"two\nlines, and ""more""",x\n2,y,z\n3,"only\n4\n4,y,z"\n5,y\n'
    (tmp_path / "m.csv").write_text(text)
    with pytest.raises(Exception, match="open quote.*set multi_line=True"):
        read_sessions_csv(spark, str(tmp_path / "m.csv")).collect()
    good, bad = split(spark, tmp_path / "m.csv", multi_line=True)
    assert good == [("1", 'two\nlines, and "more"', "x"), ("2", "y", "z")]
    assert [(r.strip(), why) for r, why in bad] == [('3,"only\n4\n4,y,z"', "too few fields"), ("5,y", "too few fields")]
    with pytest.raises(Exception, match="too few fields, in .*m.csv"):
        read_sessions_csv(spark, str(tmp_path / "m.csv"), multi_line=True).collect()
    (tmp_path / "open.csv").write_text(HEADER + '1,x,"never closed\n2,y,z\n')
    with pytest.raises(ValueError, match="open quote in .*open.csv"):
        split(spark, tmp_path / "open.csv", multi_line=True)
    (tmp_path / "many.csv").write_text(HEADER + "1,x,y,z\n")
    assert split(spark, tmp_path / "many.csv", multi_line=True) == ([], [("1,x,y,z", "too many fields")])


def test_folder_of_files(spark, tmp_path):
    """Each file has the header; bad records are counted by file; another header is an error."""
    folder = tmp_path / "parts"
    folder.mkdir()
    (folder / "1.csv").write_text(HEADER + "visitId,a,b\n1,x\n2,x\n")
    (folder / "2.csv").write_text(HEADER + '3,"x\n4,y,z\n')
    good, bad = split_sessions_csv(spark, str(folder))
    assert sorted(map(tuple, good.collect())) == [("4", "y", "z"), ("visitId", "a", "b")]
    counts = sorted((r["file"][-5:], r["reason"], r["records"]) for r in bad_record_counts(bad).collect())
    assert counts == [("1.csv", "too few fields", 2), ("2.csv", "open quote", 1)]
    (folder / "3.csv").write_text("visitId,b,a\n5,x,y\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_sessions_csv(spark, str(folder)).collect()


def test_one_column_and_no_records(spark, tmp_path):
    (tmp_path / "one.csv").write_text("visitId\n007\n\"1,\"\n2,3\n")
    assert split(spark, tmp_path / "one.csv") == ([("007",), ("1,",)], [("2,3", "too many fields")])
    (tmp_path / "none.csv").write_text(HEADER)
    assert split(spark, tmp_path / "none.csv") == ([], [])
    assert read_sessions_csv(spark, str(tmp_path / "none.csv")).columns == ["visitId", "a", "b"]
