from threadloom.sources import corpus, mail

RAW = """From: =?utf-8?q?Zo=C3=A9?= <z@x.example>
To: l@x
Subject: Re: hi
Message-ID: <1@x>
In-Reply-To: <0@x>
Date: Mon, 02 Jan 2012 13:00:05 +0100
Content-Type: multipart/alternative; boundary="b"

--b
Content-Type: text/html

<p>no</p>
--b
Content-Type: text/plain; charset=iso-8859-1
Content-Transfer-Encoding: quoted-printable

caf=E9
--b--
"""


def test_mime():
    date, fn, fe, tn, te, mid, subject, ref, text = mail.parse_message(RAW)
    assert (fn, fe, te, mid, subject, ref) == ("Zoé", "z@x.example", "l@x", "<1@x>", "Re: hi", "<0@x>") and text.strip() == "café" and date.hour == 12
    assert mail.parse_message("no headers\n\nbody")[7] == ""
    assert mail.parse_message("Content-Transfer-Encoding: base64\n\naGk=\n")[8] == "hi"


def test_mbox(spark, tmp_path):
    (tmp_path / "a.mbox").write_text("From a\n" + RAW + "\nFrom b\nSubject: two\n\n>From here\0gone\n")
    rows = mail.scan_mbox(spark, str(tmp_path)).orderBy("pos").collect()
    assert len(rows) == 2 and rows[1].raw.endswith(">From here")
    got = mail.parse_messages(spark.createDataFrame([(r.pos, r.raw) for r in rows] + [(9, None)], "seq BIGINT, raw STRING")).orderBy("seq").collect()
    assert [r.subject for r in got] == ["Re: hi", "two", None]


def test_mbox_is_split(spark, tmp_path):
    """Small blocks: the same messages in the same order, whatever the cut."""
    body = [f"Subject: s{i}\n\n" + "line é\n" * (i % 9) + (">From x\n" if i % 4 else "") for i in range(300)]
    (tmp_path / "m").mkdir()
    (tmp_path / "m/a.mbox").write_text("lead\n\n" + "".join(f"From x{i}\n{b}\n" for i, b in enumerate(body)))
    (tmp_path / "m/b.mbox").write_bytes(b"From y\nSubject: t\n\nbad \xff byte\n")
    want = None
    for size in ("128m", "1k", "300"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        df = mail.scan_mbox(spark, str(tmp_path / "m"))
        got = [(r.file[-6:], r.raw) for r in df.orderBy("file", "pos").collect()]
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
        assert len(got) == 302 and got[0] == ("a.mbox", "lead\n") and got[-1] == ("b.mbox", "Subject: t\n\nbad \ufffd byte") and (want or got) == got
        want = got
    assert [r for _, r in want[1:301]] == body


def test_tagged_files(spark, tmp_path):
    (tmp_path / "x.txt").write_text("# a\n# id\ttext/plain\tUTF-8\ttrue\tf@x\tF\tt@x\tT\nB\ta b\n\nI\tc\n")
    (tmp_path / "y.txt").write_text("# only\nB\tz\n")
    lines, heads = corpus.scan_tagged(spark, str(tmp_path))
    assert lines.where("filename = 'x.txt'").count() == 5
    assert [(r.filename, r.message_id, r.to_personal) for r in heads.collect()] == [("x.txt", "id", "T")]
    (tmp_path / "n").mkdir()
    (tmp_path / "n/list").write_text("a b\nc d")
    assert [(r.rank, r.ngram) for r in corpus.scan_words(spark, str(tmp_path / "n/list")).orderBy("rank").collect()] == [(1, "a b"), (2, "c d")]


def test_xml(spark, tmp_path):
    (tmp_path / "c.xml").write_text('<root><thread><listno>t</listno><DOC><Text><Sent id="1.1">one</Sent><Sent id="1.10"> ten </Sent></Text></DOC></thread></root>')
    (tmp_path / "a.xml").write_text('<root><thread><listno>t</listno><annotation><labels><cmt id="1.1"/><req id="1.10"/></labels></annotation><annotation><labels><x id="1.1"/></labels></annotation></thread></root>')
    assert [(r.sid, r.text) for r in corpus.scan_sentences(spark, str(tmp_path / "c.xml")).orderBy("sent_no").collect()] == [("1.1", "one"), ("1.10", "ten")]
    assert [(r.ord, r.sid, r.tag) for r in corpus.scan_annotations(spark, str(tmp_path / "a.xml")).collect()] == [(0, "1.1", "cmt"), (1, "1.10", "req")]


def test_whole_round_trip(spark, tmp_path):
    from pyspark.sql import functions as F

    from threadloom.plans import learning

    names = ["message_id", "msg_date", "from_name", "from_email", "to_name", "to_email", "subject", "in_reply_to", "text"]
    kinds = [
        ("<1 a@x>\t", "Mon, 02 Jan 2012 13:00:05 +0100", 'Müller, "Zoé" (x)', "z@x", None, "l@x", "Ré: =?x " + "long " * 300, "<0@x>", "From a\n>From b\nfin é\r\n\n"),
        (None, "?", None, None, "A B", None, None, None, None),
        ("<2@x>", None, "Ångström", "a@x", "日本 語", "l@x", " два\nстроки ", " <1@x>", "\0 naïve 😀\nFrom here"),
        ("<3@x>", None, "", "a@x", "o'x", "l@x", "", "", "ÿ only latin"),
        ("<4@x>", None, "x  y", "a@x", "=?", "l@x", "x", "<4@x>", ""),
    ]
    rows = [(i * 5 + k, *r) for i in range(4) for k, r in enumerate(kinds)]
    spark.createDataFrame(rows, "seq BIGINT, " + ", ".join(f"{n} STRING" for n in names)).write.parquet(str(tmp_path / "messages.parquet"))
    got = {r.seq: r for r in learning._round_trip(spark, str(tmp_path)).withColumn("hour", F.hour("date")).collect()}
    assert len(got) == len(rows)
    for seq, *r in rows:
        want = dict(zip(names, r))
        assert got[seq].hour == (12 if want["msg_date"] and len(want["msg_date"]) > 1 else None)
        for n in names[2:]:
            w = want[n] if n not in ("text", "in_reply_to") else want[n] or ""
            assert got[seq][n] == (w or None if n.startswith(("from", "to")) else w), (seq, n)
        assert got[seq].message_id == want["message_id"]
