"""License scans and misspelled terms, by hand-worked cases and against plain versions."""

import random
from collections import Counter

from firmlake.llm import licenses, toxicity
from firmlake.llm.common import table


def test_licenses_by_name_and_whole_text(spark):
    texts = {n: licenses.TEMPLATES[n] for n in licenses.TEXTS}
    rows = [(k, f"Some words before. {t} And after.") for k, t in enumerate(texts.values())]
    cases = {
        "Licensed under CC BY 4.0.": {"CC-BY-4.0-notice"}, "Licensed under CC BY-SA 4.0.": {"CC-BY-SA-4.0-notice"}, "Licensed under CC BY-NC-SA 4.0.": {"CC-BY-NC-SA-4.0-notice"},
        "Licensed under CC BY-NC 4.0.": {"CC-BY-NC-4.0-notice"}, "This work is licensed under the GNU General Public License, version 2.": {"GPL-2.0-notice"},
        "This work is licensed under the GNU General Public License, version 3.0.": {"GPL-3.0-notice"}, "This work is licensed under the GNU Affero General Public License, version 3.": {"AGPL-3.0-notice"},
        "Licensed under the Apache License, Version 1.1": {"Apache-1.1-notice"}, "Licensed under the terms of the Apache License, Version 2.0": {"Apache-2.0-notice"},
        "Licensed under the Apache License, Version 1.0": set(), "Released under the Apache License.": set(), "Released under the terms of the MIT License.": {"MIT-notice"},
        licenses.TEMPLATES["GPL-3.0-header"].replace("version 3", "version 2"): {"GPL-2.0-header"}, licenses.TEMPLATES["MIT"][:400]: {"MIT-grant"},
        licenses.TEMPLATES["BSD-3-Clause"].replace("the University", "Acme Limited"): {"BSD-3-Clause"}, licenses.TEMPLATES["GPL-3.0"].replace("GENERAL", "AFFERO GENERAL", 1).replace("General Public", "Affero General Public"): {"AGPL-3.0-header"},
        (licenses.TEMPLATES["MIT"] + "\n") * 2: {"MIT"},
    }
    rows += [(100 + k, t) for k, t in enumerate(cases)]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    for k, (name, text) in enumerate(texts.items()):
        (r,) = [r for r in got if r.doc_id == k]
        words = licenses.WORD.findall(text.lower())
        assert r.license == name and r.coverage == 1 and licenses.WORD.findall(r.passage.lower()) == words
    for k, (text, want) in enumerate(cases.items()):
        assert {r.license for r in got if r.doc_id == 100 + k} == want, text[:90]
    assert sum(r.doc_id == 99 + len(cases) for r in got) == 2


def test_misspelled_with_digits_and_symbols():
    m = toxicity.Matcher([(w, False) for w in toxicity.LEXICON])
    matches = lambda text: round(float(toxicity.np.expm1(m.features(text)[:4]).sum()))
    for word in ("id1ot", "m0ron", "st*pid", "ST_PID", "d*mb", "f0ol", "sc#m", "wor7hles5"):
        assert matches(f"what a {word}, really") == 1, word
    assert matches("idiot-proof") == 1 and matches("id1ot and stupid") == 2 and matches("\u201cm0ron\u201d") == 1
    for text in ("user1 sent 12 a1b2c3", "well-known co-op", "d**b", "1234", "f1st", "", None):
        assert matches(text) == 0, text
    assert m.features("you are an id1ot")[5] > 0 and m.features("he said id1ot")[4] > 0


def distance(a, b):
    """Edits between two words; two neighbouring letters that change places are one."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_against_distances():
    r = random.Random(7)
    word = lambda n: "".join(r.choice("abcd") for _ in range(n))
    terms = list(dict.fromkeys((word(r.randint(3, 11)), r.random() < 0.4) for _ in range(60)))
    a, found = toxicity.Automaton(terms, most_states=400), 0
    for _ in range(1_500):
        w = list(r.choice(terms)[0] if r.random() < 0.8 else word(r.randint(1, 12)))
        for _ in range(r.randint(0, 3)):
            k = r.randrange(len(w)) if w else 0
            w = [w[:k] + w[k + 1 :], w[:k] + [r.choice("abcd")] + w[k:], w[:k] + w[k : k + 2][::-1] + w[k + 2 :], w + [r.choice("abcd")]][r.randrange(4)]
        w = "".join(w)
        want = []
        for i, (t, stem) in enumerate(terms):
            e = min(distance(t, w[:k]) for k in range(len(w) + 1)) if stem else distance(t, w)
            if e <= toxicity.edits_allowed(t, stem):
                want.append((e, i))
        assert a.match(w) == (min(want) if want else None), w
        found += bool(want)
    assert 300 < found < 1_500


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(row[-1], last[j + 1]))
    return row[-1]


def test_licenses_against_all_places(spark, sf):
    """Every place of every text against every short template, by the plain longest common subsequence."""
    r = random.Random(9)
    index = licenses.Index(licenses.TEMPLATES)
    short = [t for t, w in enumerate(index.words) if len(w) <= licenses.LONG]
    rows = [(x.doc_id, x.text) for x in table(spark, sf, "documents").select("doc_id", "text").limit(120).collect()]
    for k in range(120):
        words = licenses.TEMPLATES[index.names[r.choice(short)]].split()
        for _ in range(r.randint(0, 4)):
            at = r.randrange(len(words))
            words = [words[:at] + words[at + 1 :], words[:at] + ["other"] + words[at:], words[:at] + ["thing"] + words[at + 1 :]][r.randrange(3)] or ["x"]
        rows.append((10_000 + k, " ".join([*r.choices(["some", "more", "words", "İ"], k=r.randint(0, 9)), *words, *r.choices(["and", "an", "end"], k=r.randint(0, 9))])))
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    text = dict(rows)
    assert all(text[x.doc_id][x.start : x.end] == x.passage for x in got)
    found = {}
    for x in got:
        found.setdefault(x.doc_id, set()).add(x.license)
    near_all = 0
    for i, raw in rows:
        words = licenses.words_of(licenses.lower(raw or ""))
        bag, near = Counter(words), set()
        for t in short:
            size, least = len(index.words[t]), licenses.COVERAGE * len(index.words[t])
            if sum(min(n, bag[w]) for w, n in index.bags[t].items()) < least:
                continue
            for k in range(len(words)):
                window = words[k : k + size + index.band[t]]
                if window[0] in index.bags[t] and sum(min(n, c) for w, c in Counter(window).items() if (n := index.bags[t][w])) >= least and longest(index.words[t], window) >= least:
                    if index.identity[t] is None or index.identity[t].search(" ".join(window)):
                        near.add(index.names[t])
                        break
        assert {n for n in found.get(i, set()) if len(index.words[index.names.index(n)]) <= licenses.LONG} <= near, i
        near_all += bool(near)
        assert not near or found.get(i), (i, near)
    assert near_all > 40
