"""Parsers of files, ledgers, tables and answers on cases worked out by hand."""

import io
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from tracewell.operators import classification, ledgers, linking, messages, planning, tables, wiring
from tracewell.sources import files, text


def archive(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members.items():
            z.writestr(name, body)
    return out.getvalue()


def test_nested_archives_end_at_the_depth():
    data = b"inner"
    for _ in range(4):
        data = archive({"x.zip" if data[:2] == b"PK" else "a.txt": data})
    said = files.file_text("top.zip", data)[1]
    assert "inner" not in said and "not expanded" in said
    assert "inner" in files.file_text("top.zip", archive({"x.zip": archive({"a.txt": b"inner"}), "__MACOSX/j": b"no"}))[1]


def test_pdf_filters():
    stream = zlib.compress(b"BT 0 700 Td (Hello ) Tj <576F726C64> Tj T* (a \\(b\\)) Tj ET")
    data = b"1 0 obj << /Filter /FlateDecode >>\nstream\n" + stream + b"\nendstream\n2 0 obj << /URI (http://x.org) >>"
    assert files.file_text("a.pdf", data) == ("pdf", "Hello World\na (b)\nhttp://x.org")
    assert files.file_text("a.pdf", b"nothing")[1] == "(no text in the file)"


def test_sheets_of_open_documents():
    table = "<t:table xmlns:t='urn:t' xmlns:p='urn:p' t:name='S'><t:table-row><t:table-cell><p:p>a</p:p></t:table-cell><t:table-cell t:number-columns-repeated='2'/><t:table-cell><p:p>b, c</p:p></t:table-cell></t:table-row></t:table>"
    assert files.file_text("a.ods", archive({"content.xml": f"<r>{table}</r>"}))[1] == '=== Sheet: S ===\na,,,"b, c"'


def test_broken_and_odd_files():
    assert files.file_text("a.xlsx", b"PK broken")[0] == "failed" and files.file_text(None, None)[0] == "empty"
    assert files.file_text("a.xml", b"<a><b>one</a>") == ("xml", "one")
    assert files.file_text("noext", b"plain text")[0] == "text" and files.file_text("x.bin", bytes(range(64)))[0] == "binary"
    assert files.file_text("a.txt", "﻿é".encode())[1] == "é"


def test_markup_is_cut_into_tokens(spark):
    cases = {
        "<head><title>x</title></head><table><tr><th>a</th><td>b</td></tr><tr><td>c</td></tr></table>": "a | b\n\nc",
        "x<!-- <b> -->y<script>if (a<b) c</script>z": "x\ny\nz",
        "a &lt;b&gt; &#8377;5 &#x1F600; &amp;lt; &#99999999; &nope;": "a <b> ₹5 \U0001f600 &lt; &#99999999; &nope;",
        "1 < 2": "1 < 2", "": "",
    }
    df = spark.createDataFrame(list(cases.items()), "html string, want string").withColumn("got", text.html_to_text(F.col("html")))
    assert {r.html: r.got for r in df.collect()} == cases


def test_json_ledgers():
    said = 'x {"from": "A1", "to": "B2", "amount": 5, "meta": {"from": "n", "to": "m"}} {bad} {"from": "A1", "to": "A1", "amount": 1}\n{"sender": "C", "payee": "D", "date": "2024-01-02"}'
    rows = list(ledgers.json_rows(said))
    assert [(r["sender"], r["receiver"], r["amount_text"], r["line"]) for r in rows] == [("A1", "B2", "5", 1), ("C", "D", None, 2)]
    assert list(ledgers.json_rows(None)) == []


def test_delimited_ledgers(spark):
    said = "STATEMENT\nAccount Number: 50100234567891\nDate;Narration;Deposit;Withdrawal\n05/01/2024;NEFT CR-RED VIPER TRADING CO;1,500.00;\n06/01/2024;\"UPI; xy@ybl\";;250\nnot a row"
    d = spark.createDataFrame([(1, said), (2, None), (3, "")], "id int, text string")
    rows = sorted((r.txn_date, r.amount, r.sender, r.receiver, r.status) for r in ledgers.ledger_transactions(d, "id").collect())
    assert rows == [
        ("2024-01-05", 1500.0, "RED VIPER TRADING CO", "50100234567891", "credit"), ("2024-01-06", 250.0, "50100234567891", "xy@ybl", "debit"),
    ]


def test_statement_lines_need_a_mark(spark):
    said = "05-Jan-2024 Debit 200000.00 ATM CASH\n2024-02-05  99,000.00  UPI vikram@ybl\n2024-02-06 we met 12000 people\n" + "2024-02-07 DR 5000 " + "x" * 400
    rows = ledgers.statement_lines(spark.createDataFrame([(1, said)], "id int, text string"), "id").collect()
    assert sorted((r.amount, r.merchant, r.upi, r.line) for r in rows) == [(99000.0, None, "vikram@ybl", 2), (200000.0, "ATM", None, 1)]


def test_chats_and_calls(spark):
    chat = "Chat with +91 98765 43210\n05/01/24, 10:30 PM - Ann: hello\n05/01/24, 10:31 PM - Ann: Messages and calls are encrypted\n[10:40] <Bob> hi\nnoise"
    calls = "A_number;B_number;date\n" + "\n".join(["9876543210;9876500000;2024-01-05"] * 2 + ["abc;9876500000;2024-01-06", "9876543210;12345678;2024-01-07"])
    d = spark.createDataFrame([(1, chat), (2, calls), (3, None)], "id int, text string")
    got = messages.communications(d, "id").collect()
    assert sorted((r.id, r.platform, r.sender, r.body) for r in got if r.id == 1) == [(1, "whatsapp", "Ann", "hello"), (1, "whatsapp", "Bob", "hi")]
    assert {r.receiver_handle for r in got if r.id == 1} == {"9876543210"} and next(r.time for r in got if r.body == "hello") == "2024-01-05T22:30:00.000Z"
    assert len([r for r in got if r.id == 2]) == 2 and not [r for r in got if r.id == 3]


def test_relationship_tables(spark):
    plain = "source,target,type\n" + "\n".join(f"Ann Lee,B{k} Ltd,OWNED_BY" for k in range(4)) + "\nZed,Zed,KNOWS"
    typed = "source,target,type\n" + "\n".join(f"Ann Lee,B{k} Ltd,PERSON" for k in range(6))
    short = "source,target,type\na b,c d,KNOWS\n"
    d = spark.createDataFrame([(1, plain), (2, typed), (3, short), (4, None)], "id int, text string")
    got = tables.relationship_table(d, "id").collect()
    assert {(r.id, r.source, r.target, r.relation) for r in got} == {(1, f"B{k} Ltd", "Ann Lee", "OWNS") for k in range(4)}


def test_chunks_hold_the_budget():
    said = "\n".join("x" * (k % 37) for k in range(400)) + "\n" + "y" * 500
    for most in (40, 100, 333):
        plain, overlapped = planning.chunk_texts(said, most), planning.chunk_texts(said, most, 30)
        assert all(len(c) <= most for c in plain + overlapped) and len(plain) == len(overlapped)
        assert "".join(plain).replace("\n", "") == said.replace("\n", "")
        assert all(o.endswith(c) for c, o in zip(plain, overlapped))


@pytest.mark.parametrize("said,want", [
    ('{"a": "\\"}{"}', {"a": '"}{'}), ("```\n{'a': 1} {\"b\": [1,],}\n```", {"b": [1]}), ('{"a": {"b": [1, 2', {"a": {"b": [1, 2]}}), ("none", None), (None, None), ("{}", {}),
])
def test_answers(said, want):
    assert planning.read_object(said) == want


def test_classes_of_names_and_texts(spark):
    rows = [(1, "", "Screenshot_2024.png"), (2, "STATEMENT OF ACCOUNT\nopening balance 5 debit credit", "a.pdf"), (3, None, None), (4, "hello there", "notes.txt")]
    d = spark.createDataFrame(rows, "id int, text string, name string")
    got = {r.id: (r["class"], r.confidence) for r in classification.classify(d, "id", F.col("name")).collect()}
    assert got[1][0] == "screenshot" and got[2][0] == "bank_statement" and got[3] == ("other", 0.0) and got[4][0] == "other"


def test_stitching_of_a_shared_token(spark):
    e = spark.createDataFrame(
        [("a", "other", "PER-1", None, [], 1), ("b", "person", "Ann Lee", None, ["per-1"], 2), ("c", "other", "PER-2", None, [], 1), ("d", "person", "Bob", None, None, 1)],
        "id string, type string, value string, label string, refs array<string>, created int",
    )
    r = spark.createDataFrame([("a", "c", "PAID", 1), ("b", "c", "PAID", 2), ("a", "b", "KNOWS", 1), ("d", "a", "KNOWS", 1)], "source string, target string, type string, weight long")
    named, moved = linking.stitch(e, r)
    assert {x.id: x.survivor for x in named.collect()} == {"a": "b", "b": "b", "c": "c", "d": "d"}
    assert {tuple(x) for x in moved.collect()} == {("b", "c", "PAID", 3), ("d", "b", "KNOWS", 1)}


def test_endpoint_types(spark):
    want = {"a.b@ybl": "upi", "+44 20 7946 0958": "phone", "9876543210": "phone", "0034100009876": "account", "Zed Traders": "organization", "Ann": None}
    d = spark.createDataFrame([(k,) for k in want], "v string")
    assert {r.v: r.t for r in d.select("v", wiring.endpoint_type(F.col("v")).alias("t")).collect()} == want
