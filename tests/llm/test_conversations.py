import random
from datetime import datetime, timedelta

from threadloom.llm import conversations as C
from threadloom.llm.conversations import conversations, turns

DAY = datetime(2012, 1, 2)


def _m(seq, mid, day=0, who="a@x", ref=None, **more):
    return {"seq": seq, "message_id": f"<{mid}>", "msg_date": (DAY + timedelta(days=day)).strftime("%Y-%m-%dT%H:%M:%SZ"), "from_email": who, "in_reply_to": ref and f"<{ref}>", "subject": "s", "text": "t", "received_at": DAY + timedelta(days=day)} | more


def test_threads(messages, mailboxes):
    rows = [
        _m(1, "a"), _m(2, "b", 1, "b@x", "a"), _m(3, "c", 400, "A@X", "b"), _m(4, "c", 3, "z@x", "a"),  # a long silence, a repeated id
        _m(10, "d"), _m(11, "e", 1, "A@x", "d"),  # one sender
        _m(20, "f"), _m(21, "g", 1, "b@x", "f", text=" \n"),  # an empty text
        _m(30, "h"), _m(31, "i", 1, "b@x", "h", msg_date="31/02/2010 10:00"),  # no date
        _m(40, "j", who=None), _m(41, "k", 1, "b@x", "j"),  # no sender of the root
        _m(50, "l", 0, "a@x", "m"), _m(51, "m", 0, "b@x", "l"),  # a circle
        _m(60, "n", subject="Report"), _m(61, "o", 1, "b@x", None, subject="Re: Report"),  # linked by subject
        _m(70, "p"),  # alone
    ]
    got = {(r.root_seq, r.turn, r.seq, r.role) for r in conversations(messages(rows, ", root BIGINT, cid STRING"), mailboxes).collect()}
    assert got == {(1, 1, 1, "initiator"), (1, 2, 2, "responder"), (1, 3, 3, "initiator"), (60, 1, 60, "initiator"), (60, 2, 61, "responder")}


def test_many_portions_and_late_messages(messages, mailboxes):
    """Messages arrive long after they were sent, in any order and from clocks that are wrong; the number of portions changes nothing."""
    rng, rows = random.Random(6), []
    for t in range(40):
        start = rng.randrange(900)
        for k in range(rng.randint(1, 5)):
            sent = start + rng.choice([0, 1, 5, 45, 100]) * k
            late = rng.choice([0, 0, 1, 20, 29, 31, 200, -400])
            rows.append(_m(0, f"{t}.{k}", sent, f"{rng.choice('abc')}@x", f"{t}.{rng.randrange(k)}" if k else None) | {"received_at": DAY + timedelta(days=sent + late), "subject": f"s{t}"})
    rng.shuffle(rows)
    rows = [r | {"seq": i + 1} for i, r in enumerate(rows)]
    one, four, nine = ({(r.root_seq, r.turn, r.seq, r.role) for r in conversations(messages(rows), mailboxes, n).collect()} for n in (1, 4, 9))
    assert one == four == nine and len(one) > 40


def test_blocks_of_a_hot_conversation(messages, mailboxes, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 8)
    rows = [_m(1, "a")] + [_m(i, f"r{i}", i % 37, f"{i % 3}@x", "a") for i in range(2, 60)]
    got = conversations(messages(rows), mailboxes).orderBy("turn").collect()
    assert [r.seq for r in got] == [1] + sorted(range(2, 60), key=lambda i: (i % 37, i)) and [r.turn for r in got] == list(range(1, 60))


def test_empty(messages, mailboxes):
    assert conversations(messages([]), mailboxes).count() == 0


def test_turns_of_a_hot_conversation(spark):
    df = spark.range(5000).selectExpr("CAST(1 AS BIGINT) AS root", "id AS seq", "CAST((id * 7919) % 3000 * 1000 AS BIGINT) AS epoch_s", "'x' AS role")
    got = [r.seq for r in turns(df).orderBy("turn").collect()]
    assert got == [s for _, s in sorted((s * 7919 % 3000 * 1000, s) for s in range(5000))]
