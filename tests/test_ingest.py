import zipfile

import pytest

from tabulon.sources import csv_ingest, documents, jsonl
from tabulon.store import Store, jsonl as to_lines


def read(spark, tmp_path, data, **how):
    p = tmp_path / "x.csv"
    p.write_bytes(data if isinstance(data, bytes) else data.encode())
    return csv_ingest.read_csv(spark, str(p), **how)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize(
    ("cells", "kind", "values"),
    [
        (['"1,234"', "5"], "double", [5.0, 1234.0]),
        (['"1,5"', "2"], "double", [2.0, 15.0]),
        (["True", "False"], "double", [0.0, 1.0]),
        (["yes", "no"], "string", ["no", "yes"]),
        (["abc", "1"], "string", ["1", "abc"]),
        ([" 12 ", "1_000", "1e5", "+5", ".5", "5."], "double", [0.5, 5.0, 5.0, 12.0, 1000.0, 100000.0]),
        (["007", "8"], "double", [7.0, 8.0]),
        (["$5", "1"], "string", ["$5", "1"]),
        (["5%", "1"], "string", ["1", "5%"]),
        (["0x10", "1"], "string", ["0x10", "1"]),
        (["(5)", "1"], "string", ["(5)", "1"]),
        (["1d", "1"], "string", ["1", "1d"]),
    ],
)
def test_numbers(spark, tmp_path, cells, kind, values):
    df = read(spark, tmp_path, "k,x\n" + "".join(f"r,{c}\n" for c in cells))
    assert dict(df.dtypes)["x"] == kind
    assert sorted(r.x for r in df.collect()) == values


def test_infinity_and_missing(spark, tmp_path):
    df = read(spark, tmp_path, "k,x\na,inf\nb,nan\nc,NA\nd,1\ne,\n")
    assert {r.k: r.x for r in df.collect()} == {"a": float("inf"), "b": None, "c": None, "d": 1.0, "e": None}


@pytest.mark.parametrize("token", ["NA", "N/A", "n/a", "#N/A", "#NA", "NULL", "null", "None", "<NA>", "nan", "NaN", "-nan", "1.#IND", ""])
def test_missing_tokens(spark, tmp_path, token):
    assert rows(read(spark, tmp_path, f"k,x\na,{token}\nb,w\n")) == [("a", None), ("b", "w")]


@pytest.mark.parametrize("token", ["-", "none", "Null", "?"])
def test_kept_tokens(spark, tmp_path, token):
    assert ("a", token) in rows(read(spark, tmp_path, f"k,x\na,{token}\nb,w\n"))


def test_delimiters(spark, tmp_path):
    assert rows(read(spark, tmp_path, "a;b\n1;2\n")) == [(1.0, 2.0)]
    assert rows(read(spark, tmp_path, "a\tb\n1\tx\n")) == [(1.0, "x")]
    got = read(spark, tmp_path, "a;b\n1;2\n", compat=True)
    assert got.columns == ["a;b"] and rows(got) == [("1;2",)]


def test_ragged_rows(spark, tmp_path):
    assert rows(read(spark, tmp_path, "a,b,c\n1,2\n3,4,5\n")) == [(1.0, 2.0, None), (3.0, 4.0, 5.0)]
    assert rows(read(spark, tmp_path, "a,b\n1,2\n3,4,5\n")) == [(1.0, 2.0)]
    got = read(spark, tmp_path, "a,b\n1,2\n3,4,5\n", compat=True)
    assert got.columns == ["a,b"] and rows(got) == [(12.0,), (345.0,)]  # one column, whose commas then go as in any number
    assert rows(read(spark, tmp_path, "a,b\n1,2,9\n3,4,5\n")) == [(2.0, 9.0), (4.0, 5.0)]


def test_encodings_quotes_blank_lines(spark, tmp_path):
    assert read(spark, tmp_path, b"\xef\xbb\xbfa,b\n1,2\n").columns == ["a", "b"]
    assert rows(read(spark, tmp_path, "a,b\né,2\n".encode("latin1"))) == [("é", 2.0)]
    assert rows(read(spark, tmp_path, 'a,b\n"x\ny",2\n')) == [("x\ny", 2.0)]
    assert rows(read(spark, tmp_path, "a,b\n\n1,2\n\n3,4\n")) == [(1.0, 2.0), (3.0, 4.0)]


@pytest.mark.parametrize(("header", "names"), [("a,a", ["a", "a.1"]), ("a, a", ["a", "a.1"]), (",b", ["Unnamed: 0", "b"]), (" a ,b", ["a", "b"])])
def test_headers(spark, tmp_path, header, names):
    assert read(spark, tmp_path, f"{header}\n1,2\n").columns == names


@pytest.mark.parametrize("data", ["", "a,b\n", "\n\n"])
def test_no_rows(spark, tmp_path, data):
    assert read(spark, tmp_path, data) is None


def test_documents(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body><w:p><w:r><w:t>one</w:t></w:r><w:r><w:t>two</w:t></w:r></w:p><w:p><w:r><w:t>three</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "b.docx").write_bytes(b"broken")
    (tmp_path / "c.xyz").write_bytes(b"text")
    got = {r.filename: r.extracted_text for r in documents.read_documents(spark, str(tmp_path), {"md": lambda b: b.decode()}).collect()}
    assert got == {"a.docx": "onetwo\nthree", "b.docx": None, "c.xyz": None}


def test_jsonl(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"type": "status", "content": "x"}\nbad\n\n{"type": "end", "done": true}\n')
    got = [(r.type, r.done) for r in jsonl.read_events(spark, str(tmp_path / "e.jsonl")).collect()]
    assert sorted(got) == [("end", True), ("status", None)]
    packets = [b'{"a": 1}\n{"b"', b": 2}\nbad\n", b'{"done": true}\n{"c": 3}']
    assert [*jsonl.reassemble(packets)] == [{"a": 1}, {"b": 2}, {"done": True}, {"c": 3}]
    assert [*jsonl.until_done(jsonl.reassemble(packets))][-1] == {"done": True}


def test_store(spark, tmp_path):
    (tmp_path / "prices.CSV").write_text("city,price\nx,\"1,000\"\ny,2\n")
    store = Store(spark, str(tmp_path / "store"))
    assert store.dataset_info(1, "s-1") == {"has_csv": False}
    made = store.ingest_dataset(str(tmp_path / "prices.CSV"), 1, "s-1")
    info = store.dataset_info(1, "s-1")
    assert made["shape"] == {"rows": 2, "cols": 2} == info["shape"] and info["dtypes"] == {"city": "string", "price": "double"}
    assert rows(store.latest_dataset(1, "s-1")) == [("x", 1000.0), ("y", 2.0)]
    assert store.latest_dataset(2, "s-1") is None
    with pytest.raises(ValueError):
        store.ingest_dataset(str(tmp_path / "x.txt"), 1, "s")
    for i in range(3):
        store.add_turn(1, f"s{i % 2}", f"question number {i} which is long", "answer")
    store.add_turn(2, "s0", "q", "a")
    assert [r.prompt[16] for r in store.history(1, "s0").collect()] == ["0", "2"]
    assert [(r.session_id, r.title) for r in store.sessions(1).collect()] == [("s0", "question number 2 wh"), ("s1", "question number 1 wh")]
    store.forget(1)
    assert store.history(1, "s0").count() == 0 and store.history(2, "s0").count() == 1
    assert to_lines(spark.range(1)).first().value == '{"id":0}'


def test_whole_file_decides(spark, tmp_path):
    """A quoted line break, a latin1 byte or a Windows-1252 byte behind the first megabyte."""
    body = "".join(f"{i},text number {i}\n" for i in range(70_000))
    assert len(body) > 1_300_000
    df = read(spark, tmp_path, "k,x\n" + body + '70000,"two\nlines"\n70001,last\n')
    assert dict(df.dtypes) == {"k": "double", "x": "string"} and df.count() == 70_002
    assert {r.x for r in df.where("k >= 70000").collect()} == {"two\nlines", "last"}
    df = read(spark, tmp_path, ("k,x\n" + body).encode() + b"70000,caf\xe9\n")
    assert df.where("k = 70000").first().x == "caf\u00e9" and df.count() == 70_001
    df = read(spark, tmp_path, ("k,x\n" + body).encode() + b"70000,5 \x80 caf\xe9\n")
    assert df.where("k = 70000").first().x == "5 \u20ac caf\u00e9"
