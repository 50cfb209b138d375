import io
import zipfile

from groundwork.operators import chunks
from groundwork.sources import office


def archive(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def test_blocks(spark):
    word = archive(**{"word/document.xml": f'<w:document {W}><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t></w:r></w:p><w:p/></w:document>'})
    sheet = archive(**{"xl/sharedStrings.xml": f"<sst {S}><si><t>PLZ</t></si></sst>", "xl/worksheets/sheet1.xml": f'<worksheet {S}><row><c t="s"><v>0</v></c><c><v>8000</v></c></row></worksheet>'})
    rows = [(1, word), (2, sheet), (3, b"%PDF-1.7"), (4, b"PK\x03\x04broken"), (5, None)]
    got = office.blocks(spark.createDataFrame(rows, "id long, raw binary"), "id", "raw").orderBy("file_id", "block_no").collect()
    assert [(r.file_id, r.kind, r.text) for r in got if r.text] == [("1", "heading", "Title"), ("1", "paragraph", "a\tb"), ("2", "row", "PLZ | 8000")]
    assert {r.file_id: r.status for r in got if not r.text} == {"3": "extraction_failed: pdf", "4": "extraction_failed: BadZipFile", "5": "extraction_failed: empty"}


def test_chunks(spark):
    spans = spark.createDataFrame([(1, k, n) for k, n in enumerate([40, 40, 40, 500, 1])] + [(2, 0, 10)], "d long, n int, size int")
    got = {(r.d, r.n): r.chunk for r in chunks.packed_chunks(spans, "d", "n", "size", 150).collect()}
    assert got == {(1, 0): 1, (1, 1): 1, (1, 2): 2, (1, 3): 3, (1, 4): 4, (2, 0): 1}
