from __future__ import annotations

import pytest
from hypothesis import given, settings, strategies as st

from factloom.operators.chunks import chunk_pages, tokens
from factloom.operators.evidence import TOKEN, best_window, dice, normal_form, trigrams, verify, verify_claims
from factloom.operators.layout import assemble
from factloom.sources.pdf import PdfError, parse_pdf


@pytest.mark.parametrize("quote, page", [("Acme   reported   revenue.", "Acme reported revenue."), ("Acme reported\nrevenue.", "Acme reported revenue."),
                                         ("Acme said “revenue increased”.", 'Acme said "revenue increased".'), ("The ﬁnancial result improved.", "The financial result improved."),
                                         ("International revenue grew.", "Inter-\nnational revenue grew.")])
def test_normalized_quotes(quote, page):
    method, score, a, b = verify(quote, page)
    assert (method, score, a, b) == ("NORMALIZED", 1.0, 0, len(page))


def test_cascade():
    page = "Before. Acme reported consolidated annual revenue of $12 million for fiscal year 2025. After."
    assert verify("Acme reported consolidated annual revenues of $12 million for fiscal year 2025.", page)[0] == "FUZZY"
    assert verify("Acme may have generated substantial revenue during the prior year.", page)[0] == "NO_RELIABLE_MATCH"
    assert verify("annual revenue", page) == ("EXACT", 1.0, page.index("annual"), page.index("annual") + 14)
    assert verify("anything", None)[0] == "PAGE_NOT_FOUND"
    assert verify("", page)[0] == "NO_RELIABLE_MATCH"


def test_claims_frame(spark):
    quote = "Acme reported revenue of $12 million."
    page = "Before context. " + "x" * 220 + " " + quote + " " + "y" * 220 + " After context."
    claims = spark.createDataFrame([(1, "p1", quote), (2, "p1", "Acme  reported revenue"), (3, "p9", quote), (4, "p1", None)], "claim_id long, page_key string, quote string")
    pages = spark.createDataFrame([("p1", page), ("p2", None)], "page_key string, text string")
    got = {r["claim_id"]: r for r in verify_claims(claims, pages).collect()}
    assert got[1]["method"] == "EXACT" and len(got[1]["context_before"]) == len(got[1]["context_after"]) == 200 and got[1]["matched_text"] == quote
    assert got[2]["method"] == "NORMALIZED" and got[2]["matched_text"] == "Acme reported revenue"
    assert got[3]["method"] == "PAGE_NOT_FOUND" and got[4]["method"] == "NO_RELIABLE_MATCH"


@given(st.text(max_size=60), st.text(max_size=60))
@settings(max_examples=100, deadline=None)
def test_dice_is_symmetric_and_bounded(a, b):
    x, y = trigrams(a), trigrams(b)
    assert dice(x, y) == dice(y, x) and 0 <= dice(x, y) <= 1 and dice(x, x) == 1


@given(st.text(max_size=80))
@settings(max_examples=100, deadline=None)
def test_normal_form_index(text):
    out, index = normal_form(text)
    assert len(out) == len(index) and index == sorted(index) and all(i < len(text) for i in index)


def brute_window(quote, page):
    n = len(TOKEN.findall(quote))
    spans, best = [m.span() for m in TOKEN.finditer(page)], 0.0
    for size in range(max(5, n - 1), n + 2) if n >= 5 else []:
        for i in range(len(spans) - size + 1):
            best = max(best, dice(trigrams(quote), trigrams(page[spans[i][0]:spans[i + size - 1][1]])))
    return best


@given(st.lists(st.sampled_from(["revenue", "a", "$5", "in", "rose", "R.D-x", "12,5", "é"]), min_size=5, max_size=8), st.lists(st.sampled_from(["revenue", "revenues", "a", "$5", "in", "; ", "rose", "R.D-x", "12,5", "b"]), max_size=25))
@settings(max_examples=150, deadline=None)
def test_sliding_window_agrees_with_brute_force(quote, page):
    q, p = " ".join(quote), " ".join(page)
    assert best_window(q, p)[0] == pytest.approx(brute_window(q, p))


def test_chunks():
    pages = [(1, "\n\n".join(f"Paragraph {i} of page one speaks of revenue." for i in range(3))), (2, "\n\n".join(f"Paragraph {i} of page two speaks of costs." for i in range(3)))]
    got = chunk_pages(pages, 40, 8)
    assert len(got) > 1 and all(c["estimated_tokens"] <= 40 for c in got) and got[0]["page_start"] == 1 and got[-1]["page_end"] == 2
    assert [c["chunk_index"] for c in got] == list(range(len(got))) and not got[0]["overlap_from_previous"] and got[1]["overlap_from_previous"]
    assert chunk_pages([(1, "")]) == [] and chunk_pages([]) == []
    with pytest.raises(ValueError):
        chunk_pages(pages, 10, 10)


@given(st.lists(st.text(alphabet="ab .\n", max_size=400), max_size=4))
@settings(max_examples=50, deadline=None)
def test_chunk_budget(texts):
    for c in chunk_pages(list(enumerate(texts, 1)), 35, 5):
        assert tokens(c["text"]) <= 35


def test_assembly():
    raw = [("paragraph.", 130, 650, 58, 12), ("Revenue", 72, 720, 45, 12), ("Second", 72, 650, 42, 12), ("  was   $1.2M ", 122, 720, 72, 12), ("in 2025.", 199, 720, 45, 12), ("  ", 10, 10, 5, 5)]
    text, items = assemble([dict(zip(("text", "x", "y", "width", "height"), r)) for r in raw])
    assert text == "Revenue was $1.2M in 2025.\n\nSecond paragraph."
    assert len(items) == 5 and all(text[i["start_character"]:i["end_character"]] == i["text"] for i in items)
    assert assemble([]) == ("", [])


def make_pdf(pages: list[list[tuple[str, int, int]]]) -> bytes:
    objects = {1: "<< /Type /Catalog /Pages 2 0 R >>", 2: f"<< /Type /Pages /Kids [{' '.join(f'{4 + 2 * i} 0 R' for i in range(len(pages)))}] /Count {len(pages)} >>", 3: "<< /Type /Font >>"}
    for i, lines in enumerate(pages):
        body = "\n".join(["BT", "/F1 12 Tf", *[f"1 0 0 1 {x} {y} Tm ({t}) Tj" for t, x, y in lines], "ET"])
        objects[4 + 2 * i] = f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Contents {5 + 2 * i} 0 R >>"
        objects[5 + 2 * i] = f"<< /Length {len(body)} >>\nstream\n{body}\nendstream"
    return ("%PDF-1.4\n" + "".join(f"{k} 0 obj\n{v}\nendobj\n" for k, v in objects.items())).encode()


def test_pdf(spark, tmp_path):
    data = make_pdf([[("Revenue was \\(net\\) $5", 72, 720), ("next line", 72, 700)], [("page two", 72, 720)], []])
    pages = parse_pdf(data)
    assert [len(p["items"]) for p in pages] == [2, 1, 0] and pages[0]["items"][0]["text"] == "Revenue was (net) $5" and pages[0]["width"] == 612
    with pytest.raises(PdfError):
        parse_pdf(b"%PDF-invalid")
    (tmp_path / "a.pdf").write_bytes(data)
    (tmp_path / "b.pdf").write_bytes(b"%PDF-invalid")
    from factloom.sources import pdf
    from factloom.sources.ingest import read_files, validate

    pdf.register(spark)
    rows = spark.read.format("pdf").load(str(tmp_path)).collect()
    assert sorted((r["page_number"] or 0, r["error"] is None) for r in rows) == [(0, False), (1, True), (2, True), (3, True)]
    files = read_files(spark, str(tmp_path))
    assert pdf.pages_of_files(files).where("error is null").count() == 3
    good, bad = validate(files, max_bytes=10_000)
    assert good.count() == 2 and bad.count() == 0
    (tmp_path / "c.pdf").write_bytes(b"hello")
    assert [r["code"] for r in validate(read_files(spark, str(tmp_path)))[1].collect()] == ["INVALID_PDF_SIGNATURE"]
