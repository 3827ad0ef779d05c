import pandas as pd

from notefold.llm import ocr
from notefold.llm.ocr import Model, PageReader, Words, _count, _edits, learn_model, paragraphs_of

LEXICON = ["plenty", "of", "water", "stood", "there", "the", "cat", "sat", "on", "stones", "halfway", "rain", "fell", "unexpectedly", "在", "再", "他们", "次", "来", "说话"]
LINES = ["plenty of water stood there"] * 80 + ["the cat sat on stones"] * 80 + ["the halnway rain fell"] * 40 + ["他们在说话", "再次来"] * 40
PLANTED = "plenty on water stood there"


def model(lines):
    counted = pd.concat(_count(LEXICON)(iter([pd.DataFrame({"text": ["\n".join(lines)]})])))
    return Model(*({(a, b): n for k, a, b, n in counted.itertuples(index=False) if k == kind} for kind in ("pair", "confusion")))


def noise(line, m):
    return {kind for _, kind in PageReader(Words(LEXICON), m).read(line, {}, None, None)[0]}


def test_the_channel_finds_a_misread_word_that_is_another_word():
    m = model([*LINES, PLANTED])
    assert noise(PLANTED, m) == {"misread"} and PageReader(Words(LEXICON), m).read(PLANTED, {}, None, None)[2] == [(1, "plenty of water stood there")]
    assert all(noise(line, m) == set() for line in ("plenty of water stood there", "the cat sat on stones"))
    assert noise(PLANTED, Model({}, {})) == set()  # without counts nothing speaks against the word as read


def test_candidates_have_no_bound_on_edits():
    words = Words(LEXICON)
    assert words.near("uncxpoctedlv")[0] == ("unexpectedly", (("c", "e"), ("o", "e"), ("v", "y")))
    assert [w for w, _ in words.near("stcnes")] == ["stones"] and words.near("zzzzzz") == []
    assert _edits("stcnees", "stones") == (("c", "o"), ("e", "")) and words.near("waler")[0][1] == (("l", "t"),)


def test_a_model_of_bounded_size_keeps_the_most_frequent(spark, monkeypatch):
    monkeypatch.setattr(ocr, "MAX_PAIRS", 3)
    pages = spark.createDataFrame([("\n".join(LINES),)], "text string")
    assert len(learn_model(pages, LEXICON).pairs) == 3


def test_a_paragraph_over_many_pages_comes_in_parts(spark):
    rows = [("s", "b", p, p, [{"anew": p == 0, "text": f"w{p} "}]) for p in range(150)]
    repaired = spark.createDataFrame(rows, "source string, backend string, page int, page_id int, paragraphs array<struct<anew:boolean,text:string>>")
    got = {r["part_no"]: r["text"] for r in paragraphs_of(repaired).collect()}
    assert sorted(got) == [1, 2, 3] and " ".join(got[k] for k in sorted(got)) == " ".join(f"w{p}" for p in range(150))
