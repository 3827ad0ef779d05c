from notefold.llm.ocr import PageReader, Words, noise_of, paragraphs_of, repair_pages

LEXICON = "the harbour was quiet and every captain waited for half-finished boats in winter long term long-term closed sensor 乐团 传感器 记录 了 新 的 港口 虽然 很 安静 船长 却 在 等待".split()


def read(text, marked=None, before=None, after=None):
    noise, paragraphs, lines = PageReader(Words(LEXICON)).read(text, marked or {}, before, after)
    return noise, paragraphs, lines


def test_cut_words():
    noise, paragraphs, _ = read("the har-\nbour was quiet and the half-\nfinished boats in the win¬ \nter")
    assert noise == {(1, "hyphen"), (3, "hyphen")}
    assert paragraphs[0][1].replace("\u0001", "").strip() == "the harbour was quiet and the half-finished boats in the winter"


def test_figures_between_the_parts_of_a_word():
    assert read("the har-\n18,712\n18.6%\nbour was quiet")[0] == {(1, "hyphen")}


def test_cut_words_over_pages():
    assert read("the har-", after="bour was quiet")[0] == {(1, "hyphen")}
    assert read("bour was quiet", before="the har-")[0] == set()
    assert read("the har-")[0] == {(1, "hyphen")}  # the rest is missing
    assert read("bour was quiet")[0] == set()
    assert read("the half-")[0] == set()


def test_misread_words():
    noise, _, lines = read("the harb0ur was qulet\nevery capta-\nln waited")
    assert noise == {(1, "misread"), (2, "hyphen"), (3, "misread")}
    assert lines[0][1] == "the harbour was quiet"


def test_chinese():
    noise, paragraphs, _ = read("  乐团记录了新的港\n囗，虽然很安静，船长却\n在等侍。")
    assert noise == {(2, "misread"), (3, "misread")}
    assert paragraphs[0][1].replace("\u0001", "").strip() == "乐团记录了新的港口，虽然很安静，船长却在等待。"


def test_source(spark):
    rows = []
    body = "the harbour was quiet and every captain waited\nfor the boats in winter the sensor closed"
    for p in range(1, 6):
        head = "Chapter 1 The Quiet Harbour\n\n" if p == 1 else "The Quiet Harbour\n"
        rows.append((p, "s", "b", 5, p, f"{head}{body}\n- {40 + p} -"))
    rows += [(10, "s", "b", 5, 7, None), (11, "s", None, 5, 1, "  \n"), (12, None, None, None, None, "the harb0ur"), (13, "t", "b", 1, 1, "quiet " * 20_000)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "page_id bigint, source string, backend string, total int, page int, text string, line_no int, kind string")
    lexicon = spark.createDataFrame([("en", w) for w in [*LEXICON, "chapter"]], "lang string, word string")
    repaired = repair_pages(df, lexicon)
    got = {(r["page_id"], r["line_no"], r["noise"]) for r in noise_of(repaired).collect()}
    want = {(p, 4, "page_no") for p in range(2, 6)} | {(1, 5, "page_no")} | {(p, 1, "header") for p in range(2, 6)} | {(12, 1, "misread")}
    assert got - want == set() and want - got == set()
    texts = [r["text"] for r in paragraphs_of(repaired).where("source = 's'").orderBy("page", "paragraph_no").collect()]
    assert texts[0] == "Chapter 1 The Quiet Harbour" and texts[1].count("winter") == 5 and len(texts) == 2
    assert repair_pages(df.limit(0), lexicon).count() == 0
