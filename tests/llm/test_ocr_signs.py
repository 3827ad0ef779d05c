import random

import pytest

from notefold.llm.ocr import Model, PageReader, Words, _han_decode, _han_options

LEXICON = "乐团 传感器 记录 了 新 的 港口 虽然 很 安静 船长 却 在 等待 没有".split()
PAIRS = {("", "船长"): 5, ("船长", "却"): 4, ("却", "等待"): 4, ("船长", "在"): 1, ("等待", ""): 1}


def test_misread_word_of_one_sign_whose_wrong_sign_begins_a_word():
    noise, paragraphs, _ = PageReader(Words(LEXICON), Model(PAIRS, {})).read("船长等等待，船长却等待。", {}, None, None)
    assert noise == {(1, "misread")} and "船长却等待，船长却等待。" in paragraphs[0][1]


def test_rest_of_a_cut_word_is_no_misread_word():
    assert PageReader(Words(LEXICON), Model(PAIRS, {})).read("有记录。船长等待港", {}, "10.4%", "7")[0] == set()


@pytest.mark.parametrize("seed", range(8))
def test_decoding_costs_what_the_plain_search_costs(seed):
    r = random.Random(seed)
    words = Words(LEXICON)
    model = Model({(r.choice(["", *LEXICON]), r.choice(LEXICON)): r.randint(1, 9) for _ in range(20)}, {("侍", "待"): 3})
    clause = "".join(r.choice("".join(LEXICON) + "侍囗") for _ in range(7))

    def least(i, before):
        if i == len(clause):
            return 0.0
        costs = []
        for j in range(i + 1, min(len(clause), i + words.longest) + 1):
            options = dict(_han_options(clause[i:j], words, model))
            if j == i + 1:
                options.setdefault(clause[i:j], 25.0)
            costs += [model.pair(before, w) + c + least(j, w) for w, c in options.items()]
        return min(costs, default=1e9)

    total, before, at = 0.0, "", 0
    for seen, word in _han_decode(clause, words, model, False, False):
        total += model.pair(before, word) + (_han_options(seen, words, model) | ({} if word in _han_options(seen, words, model) else {word: 25.0}))[word]
        before, at = word, at + len(seen)
    assert at == len(clause) and total == pytest.approx(least(0, ""))
