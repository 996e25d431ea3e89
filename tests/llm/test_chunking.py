import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spotweave.llm.chunking import _tables, pieces, split_texts
from spotweave.llm.tokens import VOCABULARY, count_tokens, encode, encoding

enc = encoding()
LENGTHS, GEAR = _tables(VOCABULARY)


def prose(seed, n):
    r = random.Random(seed)
    return "".join(r.choice(["alpha", "beta", "gamma delta", "épreuve", "42,5"]) + r.choice([" ", " ", " ", ". ", "\n", "\n\n", ", "]) for _ in range(n))


def cut(text, limit=256, overlap=32, least=64):
    return list(pieces(text, enc, LENGTHS, GEAR, limit, overlap, least))


@pytest.mark.parametrize("text", [prose(1, 3000), "QUJD" * 3000, "日本語のテキスト" * 400, "a " * 2000, "\n" * 3000, "🎉👨‍👩‍👧" * 300, prose(2, 300) + "x" * 4000 + prose(3, 300)])
def test_pieces_cover_the_text_with_the_overlap(text):
    tokens, at = enc.encode_ordinary(text), 0
    for k, (begin, n, lap, chars, said) in enumerate(cut(text)):
        assert n <= 256 and lap == (32 if k else 0) and begin == at - lap and chars <= len(said)
        raw = enc.decode_bytes(tokens[begin : begin + n])
        assert said == raw.decode("utf-8", "replace")
        at = begin + n
    assert at == len(tokens)


def test_pieces_alone_stay_under_the_limit_and_end_naturally():
    text = prose(4, 5000)
    got = cut(text)
    assert all(len(enc.encode_ordinary(p[4])) <= 256 for p in got)
    assert all(b[4].startswith(enc.decode(enc.encode_ordinary(a[4])[-32:])) for a, b in zip(got, got[1:]))
    assert sum(p[4][-1] in ".," or p[4][-1].isalnum() for p in got[:-1]) == len(got) - 1


@pytest.mark.parametrize("words, mark", [("日本語 文章 東京 天気 私は 学校 行く 見る", "。"), ("中文 句子 北京 天气 我们 学校 今天 学习", "！"), ("alpha beta gamma delta", "&nbsp;")])
def test_texts_without_white_space_are_cut_behind_marks(words, mark):
    r = random.Random(8)
    text = "".join("".join(r.choice(words.split()) for _ in range(r.randint(1, 5))) + mark for _ in range(600))
    got = cut(text)
    assert len(got) > 3 and all(p[4].endswith(mark) for p in got) and all(len(enc.encode_ordinary(p[4])) <= 256 for p in got)


def test_an_edit_changes_only_pieces_nearby():
    text, r, changed = prose(5, 20_000), random.Random(11), []
    a = {p[4] for p in cut(text)}
    for _ in range(25):
        at = r.randrange(2000, len(text) - 2000)
        b = {p[4] for p in cut(text[:at] + r.choice([" inserted words here", "x", "\n\n"]) + text[at:])}
        changed.append(len(b - a))
    # An edit changes the piece it lies in and the next one, which repeats its end; now and then some more until the cuts fall in step.
    assert sorted(changed)[len(changed) // 2] <= 3 and max(changed) <= 8, changed


def test_pieces_without_their_overlaps_are_the_text():
    for text in (prose(12, 3000), "日本語のテキスト" * 400, prose(2, 300) + "x" * 4000 + prose(3, 300)):
        assert "".join(p[4][p[3] :] for p in cut(text)) == text


def test_the_first_piece_may_use_the_whole_limit():
    assert max(p[1] for p in cut("alpha beta gamma " * 3000)[:1]) > 256 - 32 or cut("a. " * 4000)[0][1] <= 256


def test_short_null_and_empty_texts_have_no_piece(spark):
    df = spark.createDataFrame([(1, "short"), (2, None), (3, ""), (4, prose(6, 1500)), (4, prose(6, 1500)), (None, prose(7, 1500))], "doc_id long, text string")
    got = split_texts(df, "doc_id", "text").collect()
    assert {r["doc_id"] for r in got} == {4, None}
    assert sum(r["doc_id"] == 4 and r["piece_no"] == 1 for r in got) == 2
    assert split_texts(df.limit(0), "doc_id", "text").count() == 0
    n = {r["doc_id"]: r["n_tokens"] for r in count_tokens(df, "doc_id", "text").collect()}
    assert n[1] == 1 and n[3] == 0 and 2 not in n and n[4] == len(enc.encode_ordinary(prose(6, 1500)))


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab1,. \n\t\u3000\x1c"), max_size=60), st.integers(2, 6))
def test_long_white_space_is_split_as_the_pattern_does(text, long_run):
    assert encode(enc, text, long_run) == enc.encode_ordinary(text)


def test_a_million_blanks_are_read():
    text = "begin" + " \n" * 500_000 + "end. " + " " * 1_000_000
    got = list(pieces(text, enc, *_tables(VOCABULARY), 1024, 64, 320))
    assert "".join(p[4][p[3] :] for p in got) == text and max(p[1] for p in got) <= 1024
