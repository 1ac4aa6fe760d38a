import random
import zlib

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillrank.sources import files, pdf


@settings(max_examples=60, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=300), st.integers(1, 7))
def test_texts_come_back(text, lines):
    want = text.split("\n")
    assert pdf.pages(pdf.rendered(text, lines)) == ["\n".join(want[i : i + lines]) for i in range(0, len(want), lines)]


def by_hand(content, font=b"<< /Type /Font /Subtype /Type1 >>", more=b""):
    return b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj 2 0 obj << /Type /Pages /Kids [3 0 R] /Resources << /Font << /A 5 0 R >> >> >> endobj " + (
        b"3 0 obj << /Type /Page /Parent 2 0 R /Contents 4 0 R >> endobj 4 0 obj << /Length 6 0 R >> stream\n" + content + b"\nendstream endobj 5 0 obj " + font + b" endobj 6 0 obj %d endobj " % len(content) + more
    )


def test_text_operators():
    assert pdf.pages(by_hand(rb"BT /A 9 Tf 1 0 0 1 5 5 Tm (Ana \(B.\) \361) Tj 0 -12 Td [(Ma) -20 (drid) -400 (ES)] TJ T* (a\\b) Tj (c) ' ET")) == ["Ana (B.) ñ\nMadrid ES\na\\b\nc"]
    assert pdf.pages(by_hand(b"BT (x) Tj 30 0 Td <79 7A> Tj ET % (no)")) == ["xyz"]
    cmap = b"7 0 obj << /Length 90 >> stream\n1 begincodespacerange <00> <FF> endcodespacerange 2 beginbfchar <41> <0066006C> <42> <D835DC00> endbfchar 1 beginbfrange <61> <63> [<0031> <0032> <0033>] endbfrange\nendstream endobj"
    assert pdf.pages(by_hand(b"BT /A 1 Tf (ABabz) Tj ET", b"<< /Type /Font /ToUnicode 7 0 R >>", cmap)) == ["fl𝐀12�"]


def test_objects_in_streams_and_order_of_pages():
    inner = b"1 0 2 33 << /Type /Catalog /Pages 2 0 R >> << /Type /Pages /Kids [4 0 R 3 0 R] >>"
    body = zlib.compress(inner)
    raw = b"%%PDF-1.5\n9 0 obj << /Type /ObjStm /N 2 /First 9 /Filter /FlateDecode /Length %d >> stream\n%s\nendstream endobj " % (len(body), body)
    for page, content, word in ((3, 5, b"second"), (4, 6, b"first")):
        text = b"BT (%s) Tj ET" % word
        raw += b"%d 0 obj << /Type /Page /Contents [%d 0 R] >> endobj %d 0 obj << /Length %d >> stream\n%s\nendstream endobj " % (page, content, content, len(text), text)
    assert pdf.pages(raw) == ["first", "second"]


def test_broken_files_say_so():
    good = pdf.rendered("some text\nof two lines")
    for bad in (b"", b"no pdf", good[:40], good.replace(b"/Catalog", b"/Xatalog"), good.replace(b"FlateDecode", b"LZWDecodeXX"), good + b" /Encrypt 3 0 R", by_hand(b"BT (no end Tj ET")):
        with pytest.raises(pdf.PdfError):
            pdf.pages(bad)
    rng = random.Random(1)
    for _ in range(200):
        cut = bytearray(good)
        for _ in range(4):
            cut[rng.randrange(len(cut))] = rng.randrange(256)
        try:
            pdf.pages(bytes(cut))
        except Exception as e:  # noqa: BLE001  any error is reported by file
            assert not isinstance(e, (MemoryError, RecursionError))


def test_folder(spark, tmp_path):
    text = "Ana Ruiz\nAnalista | Datos\n" + "línea\n" * 80
    (tmp_path / "ana.pdf").write_bytes(pdf.rendered(text))
    (tmp_path / "rota.pdf").write_bytes(pdf.rendered("x")[:60])
    (tmp_path / "vacia.pdf").write_bytes(pdf.rendered(" \n\t"))
    got = {r["archivo"]: (r["texto"], r["error"]) for r in files.scan_pdfs(spark, str(tmp_path)).collect()}
    assert got["ana.pdf"][0].split("\n")[:2] == ["Ana Ruiz", "Analista | Datos"] and got["ana.pdf"][0].count("línea") == 80 and got["ana.pdf"][1] is None
    assert got["rota.pdf"][0] == "" and got["rota.pdf"][1].startswith("PdfError") and got["vacia.pdf"] == ("", None)
    assert files.land_pdf(spark, str(tmp_path), "nueva.PDF", pdf.rendered("texto")) == 200
    assert files.land_pdf(spark, str(tmp_path), "hueca.pdf", pdf.rendered("\n")) == 422
    df = spark.createDataFrame([(1, "a\nb"), (2, None)], "archivo int, t string").withColumn("content", pdf.render(F.col("t")))
    assert df.where("content is null").count() == 1


def test_files_of_one_writer_share_their_map():
    before = pdf._mapped.cache_info()
    assert [pdf.pages(pdf.rendered(x)) for x in ("uno ñ", "dos €")] == [["uno ñ"], ["dos €"]]
    after = pdf._mapped.cache_info()
    assert after.misses - before.misses <= 1 and after.hits > before.hits


def test_texts_leave_a_batch_in_small_ones(spark):
    """A task holds the texts of few files, however large its batches are."""
    found = []

    class Files:
        dtypes = [("archivo", "int")]

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            found.append(run)
            return self

    files.pdf_texts(Files(), lambda raw: [raw.decode()])
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array([b"x"] * 1000)], ["archivo", "content"])
    out = list(found[0]([batch]))
    assert [b.num_rows for b in out] == [256, 256, 256, 232] and pa.Table.from_batches(out).column("archivo").to_pylist() == list(range(1000))
