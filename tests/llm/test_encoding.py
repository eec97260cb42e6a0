from threadloom.llm import encoding as N


def _texts():
    clean = ["Le réglage du proxy est à moitié chargé ce matin.", "Änderung der Größe für später", "Où se trouve « la liste » désormais ?"]
    out = []
    for i in range(30):
        out += [f"{c} numéro {i}" for c in clean]
    return out


def _twisted(text, w, r):
    return "".join(N.garble(c, w, r) if ord(c) > 127 else c for c in text)


def test_align_finds_the_reading():
    clean = "déjà vu « là » Größe"
    for w, r in (("utf-8", "cp1252"), ("utf-8", "cp850"), ("cp1252", "cp1251"), ("utf-8+", "cp1252"), ("cp1252", "utf-8")):
        bad = _twisted(clean, w, r)
        found = N.align(bad, clean)
        assert found and all(x[2] in bad and x[3] in clean for x in found)
        fw, fr = found[0][:2]
        assert _twisted(clean, fw, fr) == bad and (fr == r or {fr, r} <= {"cp1252", "latin-1"})
    assert N.align(clean, clean) == [] and N.align("a é", "a e") == []


def test_characters_are_aligned():
    assert N.char_pairs("Gr├╢├ƒe ├╢", "Größe ö") == [("├ƒ", "ß"), ("├╢", "ö")]
    assert N.char_pairs("a é", "a é") == [] and N.char_pairs("ééé", "éé") == [] and N.char_pairs("�", "é") == []
    votes = {("β", "é"): 9, ("γ", "è"): 9, ("δ", "à"): 9, ("ε", "ü"): 9, ("ê", "è"): 50, ("ж", "a"): 2}
    line = [("β", "γ"), ("γ", "δ"), ("ε", "β")]
    assert N.tables(votes, line[:2], lambda c: 0) == {} and N.tables(votes, line, lambda c: 0 if "α" <= c <= "ω" else 99) == {"β": "é", "γ": "è", "δ": "à", "ε": "ü"}


def test_a_charset_that_is_not_listed_is_learned(messages):
    """Neither of the charsets is among ``CHARSETS``: one byte for each character, and UTF-8 read in a Greek one."""
    assert not {"cp737", "cp1253", "mac_greek"} & set(N.CHARSETS)
    good = _texts()
    single = lambda t: "".join(c.encode("cp1252").decode("cp737") if ord(c) > 127 else c for c in t)
    double = lambda t: "".join(c.encode().decode("mac_greek") if ord(c) > 127 else c for c in t)
    rows = [{"seq": i, "text": t} for i, t in enumerate(good * 40)]
    bad = {9000 + i: (f, t) for i, t in enumerate(good[:60]) for f in [single if i % 2 else double]}
    rows += [{"seq": s, "text": f(t)} for s, (f, t) in bad.items()]
    alone = {9500: (single, "Jamais dit à personne, voilà réglé"), 9501: (double, "Une Größe für später, à moitié dit")}  # without twins
    rows += [{"seq": s, "text": f(t)} for s, (f, t) in alone.items()] + [{"seq": 9900 + i, "text": "Ευχαριστώ, το πρόβλημα λύθηκε"} for i in range(9)]
    got = {r.seq: r.restored for r in N.examine(messages(rows)).collect()}
    right = sum(got.get(s) == t for s, (_, t) in {**bad, **alone}.items())
    assert right >= 0.95 * (len(bad) + len(alone)) and all(s in got for s in alone) and not {s for s in got if s < 9000 or s >= 9900}


def test_restoration_of_planted_pairs(messages):
    """Share of garbled lines, half of them without a twin, that come back as they were."""
    good = [f"{a} {b} n° {i}" for i in range(40) for a, b in [("Le réglage est grisé à côté,", "voilà l’été"), ("Änderung der Größe später,", "für Jörg"), ("¿Dónde está el año,", "señor Núñez?")]]
    ways = [("utf-8", "cp1252"), ("cp1252", "cp850"), ("utf-8", "mac_roman"), ("cp1252", "cp1251"), ("utf-8+", "cp1252"), ("utf-8", "koi8_r")]
    rows = [{"seq": i, "text": t} for i, t in enumerate(good[:90] * 4)]
    truth = {1000 + i: t for i, t in enumerate(good[30:])}
    rows += [{"seq": s, "text": _twisted(t, *ways[i % len(ways)])} for i, (s, t) in enumerate(truth.items())]
    got = {r.seq: r.restored for r in N.examine(messages(rows)).collect()}
    assert sum(got.get(s) == t for s, t in truth.items()) >= 0.95 * len(truth) and not {s for s in got if s < 1000}


def test_found_and_restored(spark, messages):
    good = _texts()
    ways = [("utf-8", "cp1252"), ("cp1252", "cp850"), ("utf-8", "mac_roman"), ("cp1252", "cp1251"), ("utf-8+", "cp1252")]
    bad = {1000 + 10 * i + k: (w, r, good[3 * (5 * i + k) + (0 if k < 4 else 2 * (w != "cp1252"))]) for i, (w, r) in enumerate(ways) for k in range(5)}
    rows = [{"seq": i, "text": t} for i, t in enumerate(good * 8)]
    for seq, (w, r, t) in bad.items():
        twisted = "".join(N.garble(c, w, r) if ord(c) > 127 else c for c in t)
        rows += [{"seq": seq + 100 * k, "text": "> ok\n" + twisted, "subject": twisted if k == 0 else None} for k in range(2)]
    rows += [{"seq": 5000, "text": "Le réglage est � moitié"}, {"seq": 5001, "text": "foo affiche Ã© au lieu de é, quel réglage ?"}, {"seq": 5002, "text": "Спасибо, всё работает. LÂCHER PRISE NÃO"}, {"seq": 5003}, {"seq": 5004, "text": "", "subject": ""}, {"seq": 5005, "text": "é" * 100_000}]
    got = {(r.seq, r.field_name): r.restored for r in N.examine(messages(rows, ", line STRING, n BIGINT")).collect()}
    for seq, (_, _, t) in bad.items():
        assert got[seq, "text"] == "> ok\n" + t and got[seq, "subject"] == t
    assert not {s for s, _ in got} & {5001, 5002, 5003, 5004, 5005} and all(s >= 1000 for s, _ in got)


def test_empty(messages):
    assert N.examine(messages([])).count() == 0


def test_lost_characters_come_from_twins(messages):
    good = _texts()
    lose = lambda t: "".join(N.garble(c, "cp1252", "utf-8") if ord(c) > 127 else c for c in t)
    rows = [{"seq": i, "text": t} for i, t in enumerate(good * 4)] + [{"seq": 700 + i, "text": t} for i, t in enumerate(["Le mot est pêche ici", "Le mot est pèche ici"] * 3)]
    rows += [{"seq": 1000 + i, "text": "> > " + lose(t) + " \nok", "subject": lose(t)} for i, t in enumerate(good[:12])] + [{"seq": 2000, "text": lose("Le mot est pêche ici")}, {"seq": 2001, "text": lose("Jamais écrit ailleurs, voilà")}]
    got = {(r.seq, r.field_name): r.restored for r in N.examine(messages(rows, ", line STRING, n BIGINT")).collect()}
    for i, t in enumerate(good[:12]):
        assert got[1000 + i, "text"] == "> > " + t + " \nok" and got[1000 + i, "subject"] == t
    assert got[2000, "text"] == "Le mot est p�che ici" and "�" in got[2001, "text"]
    assert {k for k in got} == {(r.seq, r.field_name) for r in N.examine(messages(rows, ", line STRING, n BIGINT"), twins=False).collect()}
