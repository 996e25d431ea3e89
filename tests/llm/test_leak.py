import base64
import quopri
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from spotweave.llm import mail
from spotweave.llm.leak import ItemAutomaton, leaked_spans, without_leaks

words = st.lists(st.sampled_from("abcd"), max_size=14)


@settings(max_examples=300, deadline=None)
@given(st.lists(words, max_size=5), st.lists(st.sampled_from("abcdx"), max_size=60), st.integers(1, 5))
def test_automaton_equals_brute_force(items, text, least):
    auto = ItemAutomaton(list(enumerate(items)), least)
    want = {}
    for k, ws in enumerate(items):
        n = min(least, len(ws))
        grams = {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if n else set()
        hit = {i + j for i in range(len(text) - n + 1) if n and tuple(text[i : i + n]) in grams for j in range(n)}
        if hit:
            want[k] = hit
    got = {}
    for item, first, n in auto.spans(text):
        got.setdefault(item, set()).update(range(first, first + n))
    assert got == want


ITEM = "The old beacon at Tulmepqua was first rebuilt in 1592 long before the café had been abandoned by its keepers"


def found(spark, texts, items=((1, ITEM), (2, "short whole item"), (3, None), (4, "..."))):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    i = spark.createDataFrame(list(items), "item_id long, item_text string")
    return {(r["doc_id"], r["item_id"]) for r in leaked_spans(d, "doc_id", "text", i, "item_id", "item_text").collect()}


def test_encodings_markup_subjects_and_attachments(spark):
    b64 = lambda s, c="utf-8": base64.encodebytes(s.encode(c)).decode()
    qp = quopri.encodestring(ITEM.encode("latin-1")).decode()
    tagged = ITEM.replace("old beacon", "o<b>l</b>d&nbsp;bea&#99;on<br>").replace("é", "&eacute;")
    texts = [
        f"Subject: x\nFrom: a@b.c\n\n{ITEM}",
        f"Subject: x\nContent-Transfer-Encoding: base64\nContent-Type: text/plain; charset=utf-16\n\n{b64(ITEM, 'utf-16')}",
        f"Subject: x\nContent-Transfer-Encoding: quoted-printable\nContent-Type: text/plain; charset=iso-8859-1\n\n{qp}",
        f"Subject: x\nContent-Type: text/html\n\n<html><style>p{{}}</style><p>{tagged}</p></html>",
        f"Subject: =?utf-8?B?{base64.b64encode(ITEM.encode()).decode()}?=\n\nnothing",
        f'Subject: x\nContent-Type: multipart/mixed; boundary="q"\n\n--q\n\nhello\n--q\nContent-Type: text/plain; name=a.txt\nContent-Disposition: attachment\nContent-Transfer-Encoding: base64\n\n{b64(ITEM)}\n--q--\n',
        "Subject: x\n\n" + "\n".join("> " + w for w in ITEM.split()),
        "Subject: x\n\n" + ITEM.replace("Tulmepqua", "Tul­mep​qua").replace("1592", "１５９２"),
        ITEM,
        " ".join(ITEM.split()[:11]),
        " ".join(ITEM.split()[3:15]),
        "a SHORT, whole\nitem!",
        "Subject: short whole\n\nitem",
        f"Subject: x From: a@b.c Content-Type: text/plain Content-Transfer-Encoding: base64 {b64(ITEM).replace(chr(10), ' ')}",
        f"Subject: x\nContent-Type: application/zip\nContent-Transfer-Encoding: base64\n\n{b64(ITEM)}",
        "", None, "Subject:\nContent-Type: multipart/mixed\nContent-Transfer-Encoding: base64\n\n\x00�", "x" * 300_000,
    ]
    assert found(spark, texts) == {(k, 1) for k in (0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 13)} | {(11, 2)}


def test_form_is_read_from_the_whole_header_block_and_body(spark):
    head = "ARC-Seal: " + "a" * 5000 + "\nX-Long: " + "b\n c" * 2000 + "\n"
    b64 = base64.encodebytes(ITEM.encode()).decode()
    texts = [
        f"{head}Subject: x\nContent-Transfer-Encoding: base64\n\n{b64}",
        "no message " * 200 + "<html><p>" + ITEM.replace("old", "o<b>l</b>d") + "</p></html>",
        f'Content-Type: multipart/mixed; boundary="zz"\n\n{"plain " * 900}<html>{ITEM.replace("old", "o<i>l</i>d")}</html>',
        "Note: no header that is known\nmore\n" + ITEM,
        "A body\n\nFrom: quoted\nSubject: below\n\n" + ITEM,
    ]
    assert found(spark, texts) == {(k, 1) for k in range(len(texts))}


def test_spans_are_characters_of_the_part():
    texts = ["a Ｂig ca­fé, 12", "x e\u0301t\u0301e y", "İstanbul ΟΔΟΣ ﬁn", "日本、語 テスト", "plain ASCII_text here", "", "  ", "\u200b a"]
    for t in texts:
        ws, at = mail.words(t), mail.word_spans(t)
        assert len(ws) == len(at) and all(a < z for a, z in at)
        for w, (a, z) in zip(ws, at):
            assert w in "".join(mail.words(t[a:z])) or w in mail.words(t[a:z])
    assert [texts[0][a:z] for a, z in mail.word_spans(texts[0])] == ["a", "Ｂig", "ca­fé", "12"]


def test_leaks_are_cut_out_and_half_leaked_parts_emptied(spark):
    rest = " ".join(f"word{i}" for i in range(60))
    texts = [f"Subject: fine\n\n{rest} -- {ITEM.upper()}! {rest}", f"Subject: short whole item\n\n{ITEM} and so", f"clean {rest}", None, "Subject: x\n\n" + " ".join(ITEM.split()[:11])]
    d = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    i = spark.createDataFrame([(1, ITEM), (2, "short whole item")], "item_id long, item_text string")
    results = [{(r["doc_id"], r["part_no"]): (r["decision"], r["text"], r["n_leaked"]) for r in without_leaks(d, "doc_id", "text", i, "item_id", "item_text", most_words=m).collect()} for m in (10**6, 5)]
    got = results[0]
    assert got == results[1]
    assert got[0, 1] == ("cut", f"{rest} --  ! {rest}", 20) and got[0, 0] == ("keep", "fine", 0)
    assert got[1, 0] == ("drop", "", 3) and got[1, 1] == ("drop", "", 20)
    assert got[2, 0][0] == got[4, 1][0] == "keep" and not any(k == 3 for k, _ in got)
    again = spark.createDataFrame([(10 * k + n, t) for (k, n), (_, t, _) in got.items()], "doc_id long, text string")
    assert leaked_spans(again, "doc_id", "text", i, "item_id", "item_text").count() == 0


def test_a_cut_does_not_make_a_new_run(spark):
    own, other = " ".join(f"own{k}" for k in range(20)).split(), " ".join(f"other{k}" for k in range(12))
    rest = " ".join(f"rest{k}" for k in range(60))
    d = spark.createDataFrame([(1, f"{rest} {' '.join(own[:6])} {other} {' '.join(own[6:17])} {rest}")], "doc_id long, text string")
    i = spark.createDataFrame([(1, " ".join(own)), (2, other)], "item_id long, item_text string")
    for mark, left in ((" ", {1}), (" [removed] ", set())):
        for most in (10**6, 15):
            t = without_leaks(d, "doc_id", "text", i, "item_id", "item_text", most_words=most, mark=mark)
            assert {r["item_id"] for r in leaked_spans(t, "doc_id", "text", i, "item_id", "item_text", most_words=most, part_no="part_no").collect()} == left


def test_nothing_to_find(spark):
    assert found(spark, ["any"], ()) == set() and found(spark, [], ((1, ITEM),)) == set()


def test_blocks_of_items_find_the_same(spark):
    r = random.Random(2)
    items = [(i, " ".join(r.choice("abcdefgh") * 2 for _ in range(15))) for i in range(20)]
    d = spark.createDataFrame([(i, t) for i, t in items], "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, item_text string")
    one, many = ({tuple(x) for x in leaked_spans(d, "doc_id", "text", i, "item_id", "item_text", most_words=m).collect()} for m in (10**6, 40))
    assert one == many and len(one) >= 20


def test_messages_within_messages_and_damaged_ones():
    nest = lambda n: "Subject: top\n" + "Content-Type: message/rfc822\n\n" * n + f"Subject: low\n\n{ITEM}"
    assert [p for p in mail.parts(nest(20)) if p] == ["top", "low", ITEM]
    assert mail.parts(nest(3000)) == [nest(3000)] and mail.words(ITEM)[-1] in mail.words(nest(3000))
    whole = "Subject: =?utf-8?q?caf=C3=A9?=\nContent-Type: multipart/mixed; boundary=b\n\n--b\nContent-Type: text/plain; charset=none\nContent-Transfer-Encoding: base64\n\naGVsbG8=\n--b--\n"
    for cut in range(len(whole)):
        for text in (whole[:cut], whole[cut:], whole[:cut] + "\0\r=?=;" + whole[cut:]):
            assert all(isinstance(p, str) for p in mail.parts(text))


def test_words():
    assert mail.words("Ａb_c d­e—f") == ["ab", "c", "de", "f"]
