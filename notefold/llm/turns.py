"""Speech transcripts as clean, ordered speaker turns.

A finite-state line parser reads the known layouts (numbered subtitles, web subtitles with voice tags, lines behind a time,
meeting exports with the speaker above the words, plain labelled lines). Labels are matched against the transcript's own
roster: by name in any spelling, part of a name, voice number or role, then by edit distance. Utterances are ordered by
time, annotations and fillers removed, and neighbours of one speaker merged. A transcript is parsed by itself, so the work
is spread by rows and no state passes between them.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notefold.session import bounded_batches, small, spread

# Words of roles and voice numbers, courtesy words behind a name, sounds of hesitation and filler phrases.
ROLES = {
    "host": {"host", "moderator", "anchor", "presenter", "主持", "主持人"},
    "guest": {"guest", "interviewee", "speakerguest", "嘉宾", "来宾", "受访者"},
    "audience": {"audience", "audiencemember", "观众", "现场观众", "听众"},
}
VOICE = re.compile(r"^(?:speaker|spk|s|voice|说话人|发言人|讲话人)0*(\d{1,3})$")
COURTESY = re.compile(r"(?:老师|先生|女士|教授|博士|同学)$")
HESITATION = r"(?:嗯|呃|额|啊|哦|噢|唔|诶|u+h+m*|u+m+|e+r+m*|h*m{2,}|hm+|ah+|eh+|oh+)"
FILLER = r"(?:就是说|然后呢|那个|这个嘛|you know|sort of|kind of|i mean)"
HEDGE = r"(?:sort of|kind of)"

# Words of sound annotations, words that only go with them, and the same for Chinese and Japanese.
SOUNDS = {
    *("applause", "clapping", "cheering", "cheers", "laughter", "laughing", "laughs", "laugh", "chuckle", "chuckles", "chuckling", "giggles", "giggling"),
    *("cough", "coughs", "coughing", "sigh", "sighs", "sighing", "sneeze", "sneezes", "sniff", "sniffs", "breath", "breathing", "gasp", "gasps", "groans"),
    *("music", "song", "singing", "humming", "whistling", "whistle", "noise", "static", "silence", "pause", "pauses", "beep", "beeps", "beeping", "buzzing"),
    *("inaudible", "unintelligible", "indistinct", "crosstalk", "mumbling", "murmuring", "chatter", "screaming", "crying", "sobbing", "yawns", "shouting"),
    *("door", "doorbell", "bell", "phone", "telephone", "footsteps", "knock", "knocks", "knocking", "siren", "click", "clicks", "thud", "bang", "throat", "sound"),
}
BESIDE = {
    *("background", "audience", "crowd", "loud", "loudly", "soft", "softly", "quiet", "quietly", "long", "short", "brief", "slow", "upbeat", "dramatic", "gentle", "nervous", "intro", "outro"),
    *("playing", "plays", "fades", "fading", "continues", "starts", "stops", "ends", "closes", "closing", "opens", "opening", "slams", "rings", "ringing", "buzzes"),
    *("clears", "clearing", "in", "out", "the", "a", "an", "of", "and", "off", "mic", "voices", "voice", "speech", "speaker", "applauds", "effect", "audio", "blank"),
}
HAN_SOUND = re.compile(
    r"(?:背景|现场|观众|全场|众人|热烈|一阵|片刻|短暂|长时间|轻|大|小|的|开场|片头|片尾)*"
    r"(?:掌声|鼓掌|笑声|大笑|轻笑|音乐|音楽|音效|咳嗽|咳|停顿|沉默|沈黙|静音|安静|噪音|杂音|电流声|听不清|无法辨认|欢呼|叹气|叹息|哭声|铃声|敲门声?|关门声?|脚步声|口哨|喷嚏|歌声|拍手|笑|間)"
    r"(?:声|响起|中|起|不断|渐弱|渐强)*"
)

#: The speaker under a label that names nobody of the roster, and the shape of such a label before a colon: names in capitals.
STRANGER = ""
NAMED = re.compile(r"[A-Z][\w'’-]+(?:\s+[A-Z][\w'’-]+){1,2}|Stranger|Unknown(?:\s+[Ss]peaker)?|未知(?:说话人|发言人)?")

_TIME = r"(?:(\d{1,3}):)?(\d{1,3}):(\d{2})(?:[.,](\d{1,3}))?"
CUE = re.compile(rf"^\s*{_TIME}\s*-->\s*[\d:.,]+.*$")
LEAD = re.compile(rf"^\s*(?:[\[(（【]\s*{_TIME}\s*[\])）】]|{_TIME}(?=\s|$))\s*(-\s+)?")
BELOW = re.compile(rf"^\s*(.{{1,60}}?)\s+[\[(]?{_TIME}[\])]?\s*$")
VOICE_TAG = re.compile(r"^\s*<v(?:\.\S+)?\s+([^>]*)>\s*(.*?)(?:</v>)?\s*$", re.S)
BRACKET_LABEL = re.compile(r"^\s*(?:>>\s*)?[\[【]\s*([^\]】]{1,60}?)\s*[\]】]\s*[:：]?\s*(.*)$", re.S)
COLON_LABEL = re.compile(r"^\s*(?:>>\s*)?([^:：]{1,60}?)\s*[:：]\s*(.*)$", re.S)
BRACKETED = re.compile(r"\[([^\[\]]*)\]|【([^【】]*)】|\(([^()]*)\)|（([^（）]*)）|\{([^{}]*)\}|\*([^*]+)\*|＊([^＊]+)＊|<([^<>]+)>")
MARKUP = re.compile(r"</?[A-Za-z][^<>]*>|<\d[\d:.,]*>|♪[^♪]*♪|♪+")
NOT_SPEECH = re.compile(rf"(?i){HESITATION}|[^\w]|_")
# A hesitation sound is never a word and goes wherever it stands alone; a filler phrase may be speech and goes only between
# punctuation or the line's edges, a hedge also where a comma parts it from what it would belong to.
_BEHIND = r"(?:\.{2,3}|…+|[，,、]|(?=[。.!！?？;；]|\s*$))\s*"
STANDALONE = (
    re.compile(rf"(?i)(?:^|(?<=[\s，。！？,.!?;；:：…]))(?:{HESITATION})(?:\.{{2,3}}|…+|[，,、]|(?=[。.!！?？\s]|$))\s*"),
    re.compile(rf"(?i)(?:^|(?<=[，。！？,.!?;；:：…])|(?<=[，。！？,.!?;；:：…]\s))(?:{FILLER}){_BEHIND}"),
    re.compile(rf"(?i)(?<![\w-]){HEDGE}[，,]\s*"),
)
HEADER = re.compile(r"(?i)^\s*(?:webvtt\b.*|note\b.{0,40}|(?:kind|language)\s*:.*|\S.{0,40}(?:字幕|asr|whisper|subtitle|caption).{0,40}|(?:asr|whisper|qwen).{0,40})\s*$")
SENTENCE = re.compile(r"[。！？!?]|\.\s|\.$|，|, ")


def _plain(label: str) -> str:
    return re.sub(r"[\s_·.\-]+", "", unicodedata.normalize("NFKC", label)).casefold()


def _distance(a: str, b: str, most: int) -> int:
    """Edit distance with transpositions, or ``most + 1`` beyond ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            best = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if older is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, older[j - 2] + 1)
            row.append(best)
        if min(row) > most:
            return most + 1
    return row[-1]


class Roster:
    """Who speaks in a transcript; ``find(label)`` gives the speaker as written in the roster, or None."""

    def __init__(self, rows: list[tuple[int, str, str]]):
        self.rows = [r for r in rows if r[1]]
        self.only = self.rows[0][1] if len({r[1] for r in self.rows}) == 1 else None
        self.names, self.parts, self.cache = {}, {}, {}
        for _, name, _ in self.rows:
            self.names.setdefault(_plain(name), name)
            words = name.split()
            for part in words if len(words) > 1 else [name[:1], name[1:]]:
                self.parts.setdefault(_plain(part), set()).add(name)

    def find(self, label: str) -> str | None:
        if label not in self.cache:
            self.cache[label] = self._find(label)
        return self.cache[label]

    def _find(self, label: str) -> str | None:
        label = re.sub(r"[（(][^（）()]*[)）]\s*$", "", label).strip(" \t-—–>*#")
        bare = _plain(label)
        if not bare or len(bare) > 48:
            return None
        short = COURTESY.sub("", bare) or bare
        for key in (bare, short):
            if key in self.names:
                return self.names[key]
        if m := VOICE.match(bare):
            return next((name for no, name, _ in self.rows if no == int(m.group(1))), None)
        for role, words in ROLES.items():
            if bare in words:
                return next((name for _, name, r in self.rows if (r or "").casefold() == role), None)
        own = self.parts.get(short, set())
        if len(own) == 1 and (len(short) > 1 or short != bare):
            return next(iter(own))
        if len(short) < 3:
            return None
        most = 1 if len(short) < 8 else 2
        near = sorted((_distance(short, key, most), key) for key in self.names)
        if near and near[0][0] <= most and (len(near) == 1 or near[1][0] > near[0][0]):
            return self.names[near[0][1]]
        near = sorted((_distance(short, key, 1), key) for key in self.parts if len(key) > 3)
        if len(short) > 3 and near and near[0][0] <= 1 and len(self.parts[near[0][1]]) == 1 and (len(near) == 1 or near[1][0] > near[0][0]):
            return next(iter(self.parts[near[0][1]]))
        return None


def _seconds(groups: tuple) -> float:
    h, m, s, f = groups
    return int(h or 0) * 3600 + int(m) * 60 + int(s) + (int(f.ljust(3, "0")) / 1000 if f else 0)


def _label(line: str, roster: Roster) -> tuple[str | None, str]:
    """The speaker a line starts with, ``STRANGER`` for a label that can be nothing else but isn't in the roster, and the
    words behind it. Other words before a colon may be speech and stay."""
    if m := VOICE_TAG.match(line):
        return roster.find(m.group(1)) or STRANGER, m.group(2)
    for kind in (BRACKET_LABEL, COLON_LABEL):
        if m := kind.match(line):
            who = roster.find(m.group(1))
            if who or VOICE.match(_plain(m.group(1))) or (kind is COLON_LABEL and NAMED.fullmatch(m.group(1).strip())):
                return who or STRANGER, m.group(2)
    return None, re.sub(r"^\s*>>\s*", "", line)


def utterances(text: str, roster: Roster) -> list[tuple[float | None, str | None, str]]:
    """``(second, speaker, words)`` in order of the text; the speaker is None where no label stands."""
    lines = re.split(r"\r\n|\r|\n", text)
    cued = any(CUE.match(line) for line in lines)
    out: list[list] = []
    time: float | None = None
    fresh = True  # the next words begin an utterance
    for i, line in enumerate(lines):
        if not line.strip():
            fresh = fresh or not cued
            continue
        if m := CUE.match(line):
            time, fresh = _seconds(m.groups()), True
            continue
        if cued and re.fullmatch(r"\s*\d+\s*", line) and i + 1 < len(lines) and CUE.match(lines[i + 1]):
            continue
        if not out and not SENTENCE.search(line) and HEADER.match(line) and _label(line, roster)[0] is None:
            continue
        if not cued and (m := LEAD.match(line)):
            time, rest = _seconds(m.groups()[:4] if m.group(2) else m.groups()[4:8]), line[m.end() :]
            if m.group(9):  # the speaker's line of an export, the words follow below
                out.append([time, roster.find(rest), ""])
                fresh = False
                continue
            who, words = _label(rest, roster)
            out.append([time, who, words])
            fresh = False
            continue
        if not cued and (m := BELOW.match(line)) and not SENTENCE.search(m.group(1)) and (who := roster.find(m.group(1))):
            time = _seconds(m.groups()[1:])
            out.append([time, who, ""])
            fresh = False
            continue
        who, words = _label(line, roster)
        if fresh or who is not None or time is None or not out:
            out.append([time, who, words])
            fresh = False
        else:
            out[-1][2] += ("\n" if out[-1][2] else "") + words
    return [tuple(u) for u in out]


def _is_sound(inside: str) -> bool:
    """Whether what stands in brackets only tells of sounds, so that it was not said."""
    words = re.findall(r"[a-z]+", inside.casefold())
    if words:
        return not re.search(r"[^\x00-\x7f]|\d", inside) and bool(SOUNDS.intersection(words)) and all(w in SOUNDS or w in BESIDE for w in words)
    bare = re.sub(r"[\s，、,.。…·~～♪]+", "", inside)
    return not bare or HAN_SOUND.fullmatch(bare) is not None


def clean_words(words: str) -> str:
    """Speech without sound annotations and fillers; empty if nothing else was there. What else stands in brackets stays."""
    words = MARKUP.sub(" ", BRACKETED.sub(lambda m: " " if _is_sound(next(g for g in m.groups() if g is not None)) else m.group(), words))
    if not NOT_SPEECH.sub("", words):
        return ""
    for pattern in STANDALONE:
        words = pattern.sub("", words)
    return re.sub(r"\s+", " ", words).strip()


def turns(text: str, roster: Roster) -> list[tuple[str | None, float | None, str]]:
    """``(speaker, second of its start, words)`` of each turn; the speaker is None before the first known one of several,
    and under a label that names nobody of the roster."""
    said = utterances(text, roster)
    if said and all(t is not None for t, _, _ in said):
        said.sort(key=lambda u: u[0])  # stable: equal times keep the text's order
    out: list[list] = []
    speaker = roster.only
    for time, who, words in said:
        speaker = roster.only or (None if who == STRANGER else who or speaker)
        words = clean_words(words)
        if not words:
            continue
        if out and out[-1][0] == speaker:
            out[-1][2] += " " + words
        else:
            out.append([speaker, time, words])
    return [tuple(t) for t in out]


def canonical_source(stored: str | None, text: str | None) -> str | None:
    """The transcript's source: as stored, or from the head of the text where it was put there; null if neither names one."""
    stored = (stored or "").strip()
    if not stored or stored.casefold() in {"unknown", "未知", "none", "null"}:
        first = re.search(r"\S[^\r\n]*", text or "")
        head = first.group().strip() if first else ""
        stored = head if HEADER.match(head) and not SENTENCE.search(head) and not head.upper().startswith("WEBVTT") else ""
    return re.sub(r"\s*[（(]\s*([^（）()]*?)\s*[)）]", r" (\1)", stored).strip().casefold() or None


def speaker_turns(transcripts: DataFrame, roster: DataFrame) -> DataFrame:
    """Turns: ``transcript_id, turn_no, known_no, speaker, start_second, words, transcript_source``.

    ``turn_no`` counts from 1 in each transcript, ``known_no`` only the turns of roster speakers. A null, blank or speechless
    text has no turn. The speaker is null where nobody can be named: before the first known one of several, under a label
    that is not in the roster, and in a transcript without roster. Repeated rows give repeated turns; other columns are left
    out.
    """
    bounded_batches(transcripts.sparkSession)
    schema = "transcript_id bigint, turn_no int, known_no int, speaker string, start_second double, words string, transcript_source string"
    own = roster.where("speaker is not null").groupBy("transcript_id").agg(F.array_sort(F.collect_set(F.struct("speaker_no", "speaker", "speaker_role"))).alias("roster"))
    joined = spread(transcripts, "transcript_id").select("transcript_id", "transcript_source", "transcript_text").where("transcript_text is not null").join(small(own, 20_000), "transcript_id", "left")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for item, source, text, people in zip(batch["transcript_id"], batch["transcript_source"], batch["transcript_text"], batch["roster"]):
                known = Roster([(p["speaker_no"], p["speaker"], p["speaker_role"]) for p in people] if people is not None else [])
                label, no = canonical_source(source, text), 0
                for i, (who, time, words) in enumerate(turns(text, known), 1):
                    no += bool(who)
                    rows.append((item, i, no if who else None, who or None, time, words, label))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")]).astype({"known_no": "Int32"})

    return joined.mapInPandas(parse, schema)
