from notefold.llm.turns import Roster, canonical_source, clean_words, speaker_turns, turns

PEOPLE = [(1, "Ana Belmont", "host"), (2, "李小明", "guest"), (3, "Cora Dahl", "audience")]


def said(text, people=PEOPLE):
    return [(who, words) for who, _, words in turns(text, Roster(people))]


def test_layouts():
    want = [("Ana Belmont", "Hello there."), ("李小明", "你好。")]
    assert said("1\n00:00:01,000 --> 00:00:02,000\nAna Belmont: Hello there.\n\n2\n00:00:03,000 --> 00:00:04,000\n李小明：你好。\n") == want
    assert said("WEBVTT\n\n00:01.000 --> 00:02.000\n<v Ana>Hello there.\n\n00:03.000 --> 00:04.000\n<v 李小明（嘉宾）>你好。") == want
    assert said("[00:03] 【李小明】你好。\n[00:01] >> ana_belmont: Hello there.") == want
    assert said("00:00:01  Moderator：Hello there.\r\n00:00:03  [说话人 2] 你好。") == want
    assert said("Ana Belmont  00:00:01\nHello there.\n\n嘉宾  00:00:03\n你好。\n") == want
    assert said("(0:01) - SPEAKER_01\nHello there.\n(0:03) - 李小名\n你好。") == want
    assert said("Ana Belmont: Hello\nthere.\n李小明老师: 你好。") == [("Ana Belmont", "Hello there."), ("李小明", "你好。")]


def test_annotations_and_hesitation_neither_form_nor_divide():
    assert said("[0:01] Ana: One.\n[0:02] Cora: [laughter]\n[0:03] Cora: Um.\n[0:04] Ana: Two.") == [("Ana Belmont", "One. Two.")]
    assert said("[0:01] Ana: One.\n[0:02] Cora: (coughs)\n[0:03] Three.") == [("Ana Belmont", "One."), ("Cora Dahl", "Three.")]


def test_words_that_look_like_labels():
    assert said("[0:01] Ana: One.\n[0:02] Note: this stays.\n[0:03] 其核心观点是：这样。") == [("Ana Belmont", "One. Note: this stays. 其核心观点是：这样。")]


def test_clean_words():
    assert clean_words("嗯，那个，今天【掌声】很好。") == "今天 很好。"
    assert clean_words("Um, you know, it works. ♪ ♪") == "it works."
    assert clean_words("（停顿） 呃……") == "" and clean_words("uh, uh") == ""


def test_no_word_of_speech_goes():
    for words in (
        "what kind of thing do you know about it", "That is what I mean by that", "as far as you know, it holds", "the figure (forty two) was read", "第二个（也就是四十二）读过了",
        "a *very* good [forty two] thing", "那个讲座然后呢就停了", "the music (he said so) was loud", "the hum of the ohm meter",
    ):
        assert clean_words(words) == words
    assert clean_words("You know, it works, I mean, mostly. Sort of.") == "it works, mostly. ."
    assert clean_words("the sort of, abundant reed") == "the abundant reed" and clean_words("[door closes] Yes (loud laughter).") == "Yes ."
    assert clean_words("（热烈的掌声）好") == "好" and clean_words("<i>so</i> it is") == "so it is"


def test_speech_nobody_can_be_named_for_is_kept():
    assert said("Welcome to the show everyone.\nAna Belmont: hello") == [(None, "Welcome to the show everyone."), ("Ana Belmont", "hello")]
    assert said("Ana: hello\nStranger: who are you\nAna: me") == [("Ana Belmont", "hello"), (None, "who are you"), ("Ana Belmont", "me")]
    assert said("Ana: hello\n[SPEAKER_09] hi\nGreat Britain: an island") == [("Ana Belmont", "hello"), (None, "hi an island")]
    assert said("Hello.", []) == [(None, "Hello.")]


def test_sources():
    assert canonical_source(None, "\n" * 500 + "本地SRT字幕\n1\n") == "本地srt字幕"
    assert canonical_source(" Whisper-base（MLX） ", "x") == "whisper-base (mlx)"
    assert canonical_source("unknown", "本地SRT字幕\n1\n") == "本地srt字幕" and canonical_source(None, "hi there.") is None


def test_table(spark):
    t = spark.createDataFrame([(1, None, "Ana: Hi."), (2, None, None), (3, None, "  "), (4, "s", "x" * 50_000), (5, None, "Ana: Hi."), (1, None, "Ana: Hi.")], "transcript_id bigint, transcript_source string, transcript_text string")
    r = spark.createDataFrame([(i, *p) for i in (1, 2, 3) for p in PEOPLE] + [(4, 1, "Solo", None), (4, 1, "Solo", None)], "transcript_id bigint, speaker_no int, speaker string, speaker_role string")
    got = sorted(((x["transcript_id"], x["turn_no"], x["speaker"]) for x in speaker_turns(t, r).collect()), key=str)
    assert [x for x in got if x[0] != 5] == [(1, 1, "Ana Belmont"), (1, 1, "Ana Belmont"), (4, 1, "Solo")] and [x for x in got if x[0] == 5] == [(5, 1, None)]
    assert speaker_turns(t.limit(0), r).count() == 0
    alone = speaker_turns(t, r.limit(0)).collect()
    assert {x["transcript_id"] for x in alone} == {1, 4, 5} and not any(x["speaker"] or x["known_no"] for x in alone)
