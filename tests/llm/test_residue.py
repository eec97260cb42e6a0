import sys
from pathlib import Path

import numpy as np

from threadloom.llm import residue as R

sys.path.insert(0, str(Path(__file__).parent))
import residue_cases as C  # noqa: E402

PROSE = [
    "Where does the mixer store its settings, in /etc/fstab or somewhere else?", "The printer queue is fine now. I will report back.", "Le réglage du proxy est grisé depuis la mise à jour.", "You should remove it and install version 3.30 instead.", "Ich habe ein Gerät mit 79 GB frei.",
    "El controlador está vacío después de cada reinicio.", "Hi Howard,", "Kind regards,", "$ ls -l", "[281.963] thing: device busy (181)",
]
FOUND = [
    "Error 404 - Not Found\nReference #1.2", "Please enable JavaScript to view the archive.\nGo back | Home | Search", "LOREM IPSUM dolor sit amet lorem adipiscing elit magna aliqua", "Hello all,\nyour text here\nRegards,", "Dear {{ first_name }},\n" + "\n".join(PROSE),
    "Your question about %%subject%% has been received on [[date]].\n" + PROSE[0], "<h1>La page est introuvable!</h1>", "Error  403  -  Forbidden", "L'équipe *|NAME|*\n" + PROSE[2],
]
CLEAN = [
    *PROSE, None, "", " \n ", "I used lorem ipsum to test the font and it cut it.\n" + PROSE[1], 'The browser shows "Please enable JavaScript to view the archive." although it is on.\n' + PROSE[0], "My mail merge still prints {{ name }} literally, how do I fill it?", 'The web panel says "404 | Not Found" and I wonder which daemon is down.', "00000000012345678901234567890",
    "http://archive.example/a?b=c&d=%20e#f",
]


def test_found(spark):
    docs = [*(PROSE * 30), *FOUND, *CLEAN, ("The old kernel stays noisy after every reboot. " * 4000)]
    df = spark.createDataFrame([(i, t, 0.0) for i, t in enumerate(docs)], "doc_id BIGINT, text STRING, filler DOUBLE")
    got = {r.doc_id for r in R.score(df).where(R.is_residue()).collect()}
    first = len(PROSE) * 30
    assert got == set(range(first, first + len(FOUND)))
    assert R.clean_documents(df).count() == len(docs) - len(FOUND)


def test_unseen_texts():
    """Held out: none of these phrases was used for the models; three parameters (OWN, CAP, LEAST) were chosen with them in view."""
    kinds = [C.ERRORS, C.SCRIPTS, C.FILLERS, C.FIELDS]
    texts = [*PROSE * 30, *sum(kinds, []), *C.MAILS]
    t = "\n".join(texts)
    model = R.models({"plain": np.bincount(R._hashes(R.plain(t)), minlength=R.BUCKETS), "masked": np.bincount(R._hashes(t, True), minlength=R.BUCKETS)})
    found = lambda ts: [f + n >= R.COVER or k > 0 for f, n, k in R.residues(ts, model)]
    hits = [found(k) for k in kinds]
    assert sum(map(len, kinds)) >= 60 and sum(map(sum, hits)) >= 0.9 * sum(map(len, kinds)) and min(sum(h) / len(h) for h in hits) > 0.8
    assert sum(found(C.MAILS)) <= 0.01 * len(C.MAILS) and sum(found(PROSE)) == 0


def test_odd_texts():
    model = R.models({"plain": np.zeros(R.BUCKETS), "masked": np.zeros(R.BUCKETS)})
    odd = ["", None, "x", "\n", "{{name}}", "\ud800 lone", "İ" * 40, " \t ", "a\n\nb", "404", '"', "*", "<b></b>", "«»"]
    assert len(R.residues(odd, model)) == len(odd) and R.residues(odd, model)[4][2] == 1 and R.residues([], model) == [] and R.residues([None, ""], model) == [(0.0, 0.0, 0)] * 2


def test_empty(spark):
    assert R.score(spark.createDataFrame([], "doc_id BIGINT, text STRING")).count() == 0
