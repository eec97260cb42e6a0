import random
from pathlib import Path

import pytest

from threadloom.llm import newtext as T
from threadloom.llm.privacy import Names

DATA = Path("/root/testdata/sf0.01")
R = T.Reducer(Names(["Alice", "Zoé"], ["holt", "ozan"]), ["Powered by tea and patience."])
PARENT = "Where does the mixer store its settings?\nThis is not urgent at all, I only wonder.\n\nZoé Garozan"


def kept(text, parent=None):
    rows = text.split("\n")
    return [rows[i - 1] for i in R.lines(text, parent)]


def test_marked_quotations():
    t = "On 2012-01-02 13:00,\nZoé Garozan <z@x.test> wrote:\n> Where does it?\n\nIn the home folder.\n> >>> more\nThat is all.\n\nCheers,\nAlice"
    assert kept(t) == ["In the home folder.", "That is all.", "Cheers,"]
    assert kept("ZG> where\nZG> what\nhere") == ["here"]


def test_own_lines_that_look_like_quotations():
    t = "Hi,\n>From there on all went black.\n>>> import thing\n| name | x | 82 |\n+------+------+\n> /etc/fstab\n-- that is all I know --\n--force is required.\nAlice"
    assert kept(t) == t.split("\n")[:-1]
    assert kept("On Tuesday somebody on the forum wrote: use it.\nFrom: and To: are empty in it.") == ["On Tuesday somebody on the forum wrote: use it.", "From: and To: are empty in it."]


def test_copies():
    head = "Fixed now.\n\n----- Forwarded -----\nFrom: Zoé Garozan <z@x.test>\nSent: 2 Jan 2012\nTo: l\nSubject: s\n\nanything"
    assert kept(head) == ["Fixed now."]
    assert kept("Fixed now.\n\nZoé Garozan wrote:\n\n" + PARENT, PARENT) == ["Fixed now."]
    assert kept("Zoé Garozan wrote:\n\n" + PARENT + "\n\nIn the folder.\nReally, believe me.", PARENT) == ["In the folder.", "Really, believe me."]
    assert kept("Fixed now.\n\n" + PARENT, PARENT) == ["Fixed now."]


def test_signatures_and_notices():
    assert kept("Done.\n-- \nAlice Yariholt\nTeacher, School\nPowered by tea and patience.\n\n" + "_" * 47 + "\nx mailing list\nhttps://lists.example/info/x") == ["Done."]
    assert kept("Done.\nMany thanks\nA.\n\nSent from my phone") == ["Done.", "Many thanks"]
    assert kept("Done.\n\nNOTICE: this mail may contain privileged material. Any copy is forbidden. Think before printing.") == ["Done."]
    assert kept("Done.\r\n--Zoé\r\n") == ["Done.\r"] and kept("") == [] and kept(" \n\n") == []
    assert len(kept("word " * 50_000)) == 1


def test_table(messages):
    m = messages(
        [{"seq": 1, "message_id": "<a>", "text": PARENT, "from_name": "Zoé Garozan"}, {"seq": 2, "message_id": "<b>", "in_reply_to": "<a>", "text": "Yes.\n\n" + PARENT, "from_name": "Zoé Yariholt"}, {"seq": 3}, {"seq": 4, "in_reply_to": "<gone>", "text": "x"}, {"seq": 5, "in_reply_to": "", "text": "y"}, {"seq": 6, "from_name": "Alice Pelozan"}, {"seq": 7, "from_name": "Alice Wesiholt"}, {"seq": None, "message_id": "<a>", "text": "z"}],
        ", before STRING, id STRING, ref STRING, sender STRING, own STRING, h BIGINT, salt INT",
    )
    got = {}
    for r in T.new_lines(m).collect():
        got.setdefault(r.seq, []).append(r.line_no)
    assert got == {1: [1, 2], 2: [1], 4: [1], 5: [1], None: [1]}
    assert T.new_lines(messages([])).count() == 0


def test_long_ancestors_and_paragraphs_count_whole():
    words = [f"{a}{b}" for a in ("mixer", "kernel", "paper", "window", "folder", "panel") for b in range(1500)]
    rng = random.Random(4)
    lines = [" ".join(rng.sample(words, 8)) for _ in range(1200)]
    for at in (0, 30, 600, 1190):
        copy = "\n".join(lines[at : at + 6])
        for parent in (copy, "\n".join(lines)):
            assert len("\n".join(lines)) > 60_000 and kept("Fixed now.\n\n" + copy, parent) == ["Fixed now."]
            assert kept("Fixed now.\n" + "\n".join("> " + x for x in copy.split("\n")), parent) == ["Fixed now."]
    whole = "\n".join(lines)
    assert T.Dictionary(whole).gain(whole) > 0.8 and T.Dictionary(whole).gain("\n".join(" ".join(rng.sample(words, 8)) for _ in range(1200))) < T.GAIN
    assert kept("Fixed now.\n\n" + whole, whole) == ["Fixed now."]
    one = " ".join(lines)
    assert kept("Fixed now.\n> " + one, one) == ["Fixed now."]


def test_closings_of_a_sender(messages):
    """Not known to any form: learned from the sender's other messages, in replies too."""
    end = "Tape Desk, third floor\nWe never close on Mondays\nAsk for the green key"
    new = [f"The reel number {chr(97 + i)} jams after {i} metres of tape." for i in range(6)]
    rows = [{"seq": i, "from_email": "T@x", "text": (f"> Which one?\n{x}" if i % 2 else x) + "\n\nCheers,\n" + end} for i, x in enumerate(new)]
    rows += [{"seq": 10, "from_email": "t@x", "text": "No sign here.\n\n" + end}, {"seq": 11, "from_email": "other@x", "text": "Ask for the green key\nat the desk."}]
    got = {}
    for r in T.settled_lines(messages(rows)).collect():
        got.setdefault(r.seq, {})[r.line] = r.how
    for i, x in enumerate(new):
        assert [y for y, h in got[i].items() if h == T.NEW] == [x, "Cheers,"] and [y for y, h in got[i].items() if h == T.OWN_CLOSING] == end.split("\n")
    assert got[10] == {"No sign here.": T.NEW} | dict.fromkeys(end.split("\n"), T.OWN_CLOSING)
    assert set(got[11].values()) == {T.NEW}


def test_reworded_notice_of_the_archive():
    notice = "This letter is for the eyes of the addressee alone and nobody else may copy, print or show it without asking us beforehand in writing."
    r = T.Reducer(Names([], []), [notice], forms=False)
    assert r.decide("New text.\n\n" + "Please note. " + notice[12:110] + " Thank you.")[2] == T.OWN_CLOSING
    assert r.decide("The addressee alone may copy and print the manual of the mixer, I was told by its maker.") == [T.NEW]


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_dictionaries_decide_unmarked_variants(spark):
    """Quotation marks, introductions and signature marks are taken off: compression alone finds most of what the forms had shown."""
    m = spark.read.parquet(f"{DATA}/messages.parquet")
    common, closings = T.learn_closings(m)
    rows = T.with_dictionaries(m, closings).collect()
    forms, bare = T.Reducer(*[R.names], common), T.Reducer(R.names, common, forms=False)
    quoted = found = signed = closed = new = wrong = 0
    for r in rows:
        source = T.Dictionary(r.before) if r.before else None
        own = T.Dictionary(r.own, True) if r.own else None
        text, want = [], []
        for x, how in zip(r.text.split("\n"), forms.decide(r.text, r.before, r.own)):
            b = T.bone(T.unmarked(x)[1])
            if how == T.NEW or how == T.BLANK:
                text, want = [*text, x], [*want, how]
            elif T._MARK.match(x) and source and len(b) > 20 and b in source.whole:
                text, want = [*text, T.unmarked(x)[1]], [*want, "quoted"]
            elif own and not T._SIGN.match(x) and not T._MARK.match(x) and T.figures(b) in own.lines and len(b) > 8:
                text, want = [*text, x], [*want, "signed"]
        for i, (w, how) in enumerate(zip(want, bare.decide("\n".join(text), r.before, r.own))):
            lone = not any(0 <= k < len(want) and want[k] == "quoted" for k in (i - 1, i + 1))
            quoted, found = quoted + (w == "quoted" and not lone), found + (w == "quoted" and not lone and how == T.ANCESTOR)
            signed, closed = signed + (w == "signed"), closed + (w == "signed" and how == T.OWN_CLOSING)
            new, wrong = new + (w == T.NEW), wrong + (w == T.NEW and how != T.NEW)
    assert quoted > 200 and signed > 100 and found > 0.9 * quoted and closed > 0.8 * signed and wrong < 0.01 * new, (quoted, found, signed, closed, new, wrong)
