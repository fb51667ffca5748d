import random
import re

import duckdb

from railyard.llm import licences as li


def kind(sentence):
    known = li.table_of(li.SENTENCES)
    if sentence in known:
        return known[sentence]
    for name, form in li.SLOTS.items():
        before, behind = form.split("{}")
        if sentence.startswith(before) and sentence.endswith(behind) and 0 < len(sentence) - len(before) - len(behind) <= 90:
            return name
    if not re.match(li.TITLE, sentence) and any(x in sentence for x in ("licens", "licenc", "warrant", "permi", "redistribut", "copyright")):
        return "Unknown"
    return "~"


def brute(text):
    known = li.table_of(li.SENTENCES)
    rest = [kind(n) for p in re.split(li.BREAK, text or "") if (n := li.normalise(p))]
    if not set(rest) - {"Unknown", "~"}:
        return [], "", "none"
    ids, found = [x for x in rest if x != "~"], []
    for name, seq in li.RULES:
        want = [x for n in seq for x in li._parts(n, li.SENTENCES, known)]
        at = 0
        while at + len(want) <= len(rest):
            if rest[at : at + len(want)] == want:
                rest[at : at + len(want)] = [None]
                found.append(name)
            at += 1
    order = list(dict.fromkeys(n for n, _ in li.RULES))
    left = [x for x in rest if x not in (None, "~", *li.COMPANIONS)]
    return ids, ",".join(sorted(set(found), key=order.index)), "known" if found and not left else "unmatched"


def texts():
    rnd = random.Random(2)
    every = [s for v in li.SENTENCES.values() for s in v] + ["Some words.", "éà", "Copyright (c) 2020 A Person", "MIT License", "Do not redistribute.", "Neither the name of ACME nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "This product includes software developed by the University.", "released UNDER the mit\tlicense"]
    bsd = ["BsdPre", "BsdSource", "BsdBinary", "BsdEndorse"]
    return [None, "", "\n\n", " ".join(li.SENTENCES[x][0] for x in bsd), "\n".join(li.SENTENCES[x][0] for x in bsd[:3]), "x. " * 30_000 + "Released under the MIT License.",
            *["".join(rnd.choice(every) + rnd.choice([" ", "\n", "  \r\n"]) for _ in range(rnd.randint(1, 9))) for _ in range(200)]]


def test_scan_like_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string").selectExpr("*", "1 as verdict")
    for r in li.scan(df).collect():
        assert (r.sentence_ids, r.licences, r.verdict) == brute(texts()[r.doc_id])
    assert li.scan(df.limit(0)).count() == 0


def test_every_rule_can_match():
    for name, seq in li.RULES:
        assert name in brute("\n".join(li.SENTENCES[x][0] if x in li.SENTENCES else li.SLOTS[x].format("acme") for x in seq))[1].split(",")


def test_oracle_sql():
    import pandas as pd

    documents = pd.DataFrame({"doc_id": range(len(texts())), "text": texts()})  # noqa: F841
    for doc, n, ids, found, verdict in duckdb.sql(li.oracle()).fetchall():
        want = brute(texts()[doc])
        assert (n, ids, found, verdict) == (len(want[0]), ",".join(want[0]), *want[1:])


def test_sentences_that_run_over_lines(spark):
    import textwrap

    def wrapped(names, prefix="", gap="\n", width=80):
        return gap.join(textwrap.fill(li.SENTENCES[x][0], width, initial_indent=prefix, subsequent_indent=prefix) for x in names)

    mit, bsd = ["MitGrant", "MitNotice", "AsIsMit"], ["BsdPre", "BsdSource", "BsdBinary"]
    gpl = ["GplFree", "GplHope"]
    more = [(["GplFree2", "GplHope"], "GPL-2.0-or-later"), (["LgplFree", "LgplHope"], "LGPL-2.1-or-later"), (["LgplFree3"], "LGPL-3.0-or-later"), (["AgplFree", "GplHope"], "AGPL-3.0-or-later"), (["MplCopy"], "MPL-2.0"), (["IscGrant"], "ISC"), (["Unencumbered"], "Unlicense"), (["EplTerms"], "EPL-2.0"), (["BoostName"], "BSL-1.0"), (["ZlibGrant"], "Zlib"), (["CcZero"], "CC0-1.0")]
    cases = [
        (wrapped(mit, gap="\n\n"), "MIT"), (wrapped(mit, " * ", "\n *\n"), "MIT"), (wrapped(mit, "# ").replace("\n", "\r\n"), "MIT"),
        (wrapped(bsd, "// "), "BSD-2-Clause"), (wrapped([*bsd, "BsdEndorse"], "dnl "), "BSD-3-Clause"), (wrapped(gpl, "    ", "\n\n", 60), "GPL-3.0-or-later"),
        ("Copyright (c) 2020 A. Person\nAll rights reserved\n\n" + wrapped(mit), "MIT"),
        *((wrapped(names, " * ", "\n *\n", 72), name) for names, name in more),
        (wrapped(["MitNotice"]).replace("\n", "\n\n"), ""), ("not " + wrapped(mit[:1]), ""),
    ]
    df = spark.createDataFrame([(k, x) for k, (x, _) in enumerate(cases)], "doc_id long, text string")
    assert {r.doc_id: r.licences for r in li.scan(df).collect()} == {k: want for k, (_, want) in enumerate(cases)}


def whole(*names):
    return " ".join(li.SENTENCES[x][0] if x in li.SENTENCES else x for x in names)


MIT = ("MIT License\n\nCopyright (c) 2020 A Person\n\n", "MitGrant", "MitNotice", "AsIsMit", "MitLiable")
BSD = ("BsdPre", "BsdSource", "BsdBinary")
ENDORSE = "Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
HEADER = "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an \"AS IS\" BASIS,\nWITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\nSee the License for the specific language governing permissions and\nlimitations under the License.\n"


def test_what_restricts_a_licence_is_not_known(spark):
    cases = [
        (whole(*MIT), "MIT", "known"),
        (whole(*MIT[:3], "The Software shall be used for Good, not Evil.", *MIT[3:]), "MIT", "unmatched"),
        (whole("Licensed under the MIT License. Commercial use is not permitted without a separate agreement."), "MIT", "unmatched"),
        (whole(*BSD, "BsdAds", "This product includes software developed by the University.", ENDORSE.format("the University")), "BSD-4-Clause", "known"),
        (whole(*BSD, "All advertising must thank us.", ENDORSE.format("the University")), "BSD-2-Clause", "unmatched"),
        (whole(*BSD, ENDORSE.format("Acme Inc.")), "BSD-3-Clause", "known"),
        (whole(*BSD, ENDORSE.format("Acme\n * Corporation")), "BSD-3-Clause", "known"),
        (HEADER, "Apache-2.0", "known"),
        (HEADER + "You may not redistribute it for money.", "Apache-2.0", "unmatched"),
        (whole("GplFree", "GplHope", "GplSee", "GplCopy", "GplWhere"), "GPL-3.0-or-later", "known"),
        (whole("GplSee"), "", "unmatched"),
        ("Some prose.\nReleased under the MIT License.\nMore prose. And more.", "MIT", "known"),
        ("One may not redistribute this.", "", "none"),
    ]
    df = spark.createDataFrame([(k, x, "mine", "own") for k, (x, *_) in enumerate(cases)], "doc_id long, text string, __rest string, hit0 string")
    rows = li.scan(df).collect()
    assert {r.doc_id: (r.licences, r.verdict) for r in rows} == {k: want for k, (_, *w) in enumerate(cases) for want in [tuple(w)]}
    assert all((r["__rest"], r.hit0) == ("mine", "own") for r in rows)
