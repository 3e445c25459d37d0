"""Whole licence files: they are told apart, count as licence files, and speak for their directories."""

import textwrap

import pytest

from labelflow.llm import license_scan as ls

GRANT = ls.TEMPLATES["MIT"][4]
MIT = ["MIT License", "Copyright (c) 2024 A. Writer", GRANT, *ls.BODIES["MIT"]]
HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
ONE, TWO, NO_WARRANTY = ls.BODIES["BSD-2-Clause"]
BSD2 = ["Copyright (c) 2024, A. Writer", "All rights reserved.", HEAD, "1. " + ONE, "2. " + TWO, NO_WARRANTY]
BSD3 = [*BSD2[:5], "3. " + ls.BODIES["BSD-3-Clause"][0], NO_WARRANTY]
APACHE = ["Apache License Version 2.0, January 2004", *[f"{i}. {p}" for i, p in enumerate(ls.BODIES["Apache-2.0"])], "Copyright 2024 A. Writer", ls.TEMPLATES["Apache-2.0"][2]]


def files(width, gap):
    return {n: gap.join("\n".join(textwrap.wrap(p, width)) for p in ps) for n, ps in (("MIT", MIT), ("BSD-2-Clause", BSD2), ("BSD-3-Clause", BSD3), ("Apache-2.0", APACHE))}


def matchers():
    return [ls._matcher(tuple((k, tuple(v)) for k, v in t.items())) for t in (ls.TEMPLATES, ls.BODIES)]


@pytest.mark.parametrize("width, gap", [(72, "\n\n"), (78, "\n\n"), (10_000, "\n"), (64, "\n\n")])
@pytest.mark.parametrize("name", ["MIT", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0"])
def test_whole_files(name, width, gap):
    m, more = matchers()
    got = ls.scan_text(files(width, gap)[name], m, 0.75, more)
    assert got[0] == name and got[1] >= 0.75 and got[3] >= 0.5


def test_bodies_alone_or_quoted_are_no_licence():
    m, more = matchers()
    assert ls.scan_text("\n\n".join(ls.BODIES["MIT"]), m, 0.75, more)[0] is None
    assert ls.scan_text("", m, 0.75, more) == (None, 0.0, None, 0.0)
    said = ls.scan_text(MIT[0] + "\n\n" + "\n".join(["plain words of a story told at length"] * 200), m, 0.75, more)
    assert said[0] == "MIT" and said[3] < 0.5


def test_directories_inherit_from_whole_files(spark):
    rows = [(i, f"d{i}/LICENSE", t) for i, t in enumerate(files(72, "\n\n").values())]
    rows += [(10 + i, f"d{i}/src/a.py", "x = 1") for i in range(4)] + [(20, "e/a.py", None), (21, None, ""), (21, None, "")]
    got = {r["doc_id"]: r for r in ls.scan(spark.createDataFrame(rows, "doc_id bigint, path string, text string")).collect()}
    names = list(files(72, "\n\n"))
    assert all(got[i]["is_license_file"] and got[i]["license"] == names[i] for i in range(4))
    assert [(got[10 + i]["effective_license"], got[10 + i]["distance"]) for i in range(4)] == [(n, 1) for n in names]
    assert got[20]["effective_license"] is None and got[21]["effective_license"] is None
