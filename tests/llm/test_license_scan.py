import re

import pytest

from corpusframe.llm import license_scan as L
from corpusframe.llm.tables import table
from tests.llm.fixtures import awkward, docs_of


@pytest.fixture(scope="module")
def documents(spark):
    return table(spark, "/root/testdata/sf0.01", "documents")


@pytest.fixture(scope="module")
def model(documents):
    return L.fit(documents)


NOTICES = {
    "Licensed under CC BY-NC 4.0.": "cc-by-nc",
    "Licensed under the Apache License, Version 2.0.": "apache-2.0",
    "Released under the MIT License.": "mit",
    "This work is licensed under the GNU General Public License, version 3.": "gpl",
}


def test_notices_in_the_documents(documents, model):
    """Every notice line of the documents is found, and nothing else."""
    want = set()
    for r in documents.select("doc_id", "text").collect():
        for notice, family in NOTICES.items():
            if notice in re.split(r"(?<=[.!?])\s+|\n", r["text"]):
                want.add((r["doc_id"], family))
    got = {(r["doc_id"], r["family"]) for r in L.license_report(documents, model=model).collect()}
    assert got == want and len(want) > 20


def test_held_out_accuracy(documents, model):
    rows = L.training_rows(documents).where("held").withColumnRenamed("family", "truth")
    got = model.predict(rows).selectExpr("truth", "if(probability >= %f, family, 'unknown') family" % model.level).collect()
    known = [r for r in got if r["truth"] != L.UNKNOWN]
    other = [r for r in got if r["truth"] == L.UNKNOWN]
    assert sum(r["family"] == r["truth"] for r in known) / len(known) > 0.6  # short windows that licences share count against
    assert sum(r["family"] != L.UNKNOWN for r in other) / len(other) < 0.02


def test_wrapped_and_inlined_notices(spark, model):
    mit = L.TEMPLATES["mit"][3]
    wrapped = "\n".join(re.findall(r".{1,70}(?:\s|$)", mit))
    rows = awkward() + [
        (100, f"Some prose here.\n\n{wrapped}\n\nMore prose."), (101, "We like it. Released under the MIT License. Thanks!"),
        (102, "The license to kill is no software licence."), (103, "public License the under GNU version General licensed 3"),
        (104, "Licensed under CC BY-SA 4.0.\nLicensed under CC BY 4.0."), (105, "Use of this source code is a matter of taste."),
    ]
    got = {(r["doc_id"], r["family"]) for r in L.license_report(docs_of(spark, rows), model=model).collect()}
    assert got == {(100, "mit"), (101, "mit"), (104, "cc-by-sa"), (104, "cc-by")}


SHORT_NOTICES = {
    "SPDX-License-Identifier: MIT": {"mit"}, "MIT License": {"mit"}, "The MIT License": {"mit"}, "Apache License, Version 2.0": {"apache-2.0"},
    "GNU General Public License": {"gpl"}, "Licensed under the Apache License 2.0": {"apache-2.0"},
    "Released under the Apache License, Version 2.0": {"apache-2.0"}, "Distributed under the MIT License": {"mit"}, "Licensed under CC BY 3.0": {"cc-by"},
    "License: BSD-3-Clause": {"bsd"}, "Dual licensed under MIT or Apache-2.0.": {"mit", "apache-2.0"}, "Released under GPLv3": {"gpl"},
    "Foo Bar is licensed under the GNU Lesser General Public License v2.1 or later.": {"lgpl"}, "Mozilla Public License, v. 2.0": {"mpl-2.0"},
    "Licensed under CC BY-NC-SA 4.0": set(), "Apache License, Version 1.1": set(), "Mozilla Public License, v. 1.1": set(),
    "GNU Affero General Public License": set(), "She went to MIT under protest.": set(), "He studied at MIT": set(), "The licence": set(),
    "This is not the MIT License": set(), "Is this the MIT License?": set(), "MIT software": set(), "Apache Software Foundation": set(),
}


def test_short_and_reworded_notices(spark, model):
    notices = list(SHORT_NOTICES)
    rows = [(i, t) for i, t in enumerate(notices)] + [(1000 + i, f"Prose of a page.\n\n{t}\n\nMore prose.") for i, t in enumerate(notices)]
    got = {}
    for r in L.license_report(docs_of(spark, rows), model=model).collect():
        got.setdefault(r["doc_id"], set()).add(r["family"])
        assert r["similarity"] >= L.SIMILARITY
    for i, t in enumerate(notices):
        assert got.get(i, set()) == SHORT_NOTICES[t] == got.get(1000 + i, set()), t


def test_no_user_function(documents, model):
    plan = L.license_report(documents, model=model)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_markers_hold_in_every_template():
    for texts in L.TEMPLATES.values():
        for t in texts:
            for s in re.split(r"(?<=[.!?])\s+", t):
                if len(s.split()) >= 5 and "You can obtain one" not in s and "required by applicable" not in s:
                    assert re.search(L.MARKERS[4:], s, re.I) or "waived" in s or s.startswith("You may"), s


def test_empty_table(spark, model):
    assert L.license_report(docs_of(spark, []), model=model).count() == 0
    assert L.license_report(docs_of(spark, [])).count() == 0
