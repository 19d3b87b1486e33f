"""Licence scans by sentence rules.

A text is cut into sentences, each is normalised (lower case, "licence" as "license", marks to blanks, years and signs of copyright
dropped), and a normalised sentence that a known licence sentence matches becomes that sentence's identifier. The sequence of
identifiers of a document is then matched against ordered rules, longest first: a rule wants its identifiers in order, with
at most `GAP` other identifiers between two; what a rule has used is not used again.

Only texts with a word that every known sentence needs leave the JVM; the test for it reads the whole text. Results are per document:
licences (names joined by comma in order of place), matches (name:start:end in code points of the text, end exclusive), n_sentences
(identified ones) and n_unused (those that no rule has used).

Defined results: null and empty texts have none of either; a text that states a licence twice has it twice in matches and once in
licences; repeated rows get one result each; an empty table gives an empty result."""
from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import table

#: Other identifiers that may stand between two of a rule.
GAP = 3

# Known licence sentences, as patterns over normalised sentences, and the rules made of them.
UNDER = r"(?:licensed|released|distributed|published|available|provided|covered|is|are|made available|use of this \w+ is governed) (?:by|under|according to) (?:the )?(?:terms of )?(?:the )?"
SENTENCES: dict[str, str] = {
    "apache2.name": UNDER + r"apache (?:software )?license (?:version )?2(?:\.0)?\b",
    "apache2.obtain": r"you may obtain a copy of the license at",
    "apache2.comply": r"you may not use this file except in compliance with the license",
    "apache2.asis": r"distributed under the license is distributed on an as is basis",
    "mit.name": UNDER + r"mit license\b",
    "mit.grant": r"permission is hereby granted free of charge to any person obtaining a copy of this software",
    "mit.notice": r"above copyright notice and this permission notice shall be included in all copies or substantial portions",
    "mit.asis": r"the software is provided as is without warranty of any kind express or implied",
    "isc.grant": r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "isc.asis": r"the software is provided as is and the author disclaims all warranties",
    "bsd.name": UNDER + r"(?:new |modified |simplified )?bsd (?:[23] clause )?license\b",
    "bsd.grant": r"redistribution and use in source and binary forms with or without modification are permitted",
    "bsd.source": r"redistributions of source code must retain the above copyright notice",
    "bsd.binary": r"redistributions in binary form must reproduce the above copyright notice",
    "bsd.endorse": r"may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd.asis": r"this software is provided by the (?:copyright holders?|regents|author).* as is and any express or implied warranties",
    "agpl3.name": r"(?:gnu )?affero general public license (?:as published by the free software foundation (?:either )?)?(?:version|v) ?3\b",
    "lgpl3.name": r"(?:gnu )?lesser general public license (?:as published by the free software foundation (?:either )?)?(?:version|v) ?3\b",
    "lgpl21.name": r"(?:gnu )?lesser general public license (?:as published by the free software foundation (?:either )?)?(?:version|v) ?2\.1\b",
    "gpl3.name": r"(?<!affero )(?<!lesser )(?:gnu )general public license (?:as published by the free software foundation (?:either )?)?(?:version|v) ?3\b",
    "gpl2.name": r"(?<!affero )(?<!lesser )(?:gnu )general public license (?:as published by the free software foundation (?:either )?)?(?:version|v) ?2\b",
    "gpl.free": r"this program is free software you can redistribute it and or modify it under the terms of the",
    "gpl.warranty": r"distributed in the hope that it will be useful but without any warranty",
    "gpl.copy": r"you should have received a copy of the gnu (?:lesser |affero )?general public license",
    "mpl2.name": r"subject to the terms of the mozilla public license v(?:ersion)? ?2\.0|" + UNDER + r"mozilla public license (?:version |v ?)?2\.0",
    "cc0.name": UNDER + r"(?:cc0\b|creative commons (?:zero|cc0))",
    "ccbyncnd4.name": UNDER + r"(?:cc by nc nd|creative commons attribution non ?commercial no ?derivatives) (?:license )?4\.0",
    "ccbyncsa4.name": UNDER + r"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike) (?:license )?4\.0",
    "ccbync4.name": UNDER + r"(?:cc by nc|creative commons attribution non ?commercial) (?:license )?4\.0",
    "ccbysa4.name": UNDER + r"(?:cc by sa|creative commons attribution share ?alike) (?:license )?4\.0",
    "ccby4.name": UNDER + r"(?:cc by|creative commons attribution) (?:license )?4\.0",
    "unlicense.grant": r"this is free and unencumbered software released into the public domain",
    "unlicense.use": r"anyone is free to copy modify publish use compile sell or distribute this software",
    "public.domain": r"(?:dedicated|released|placed) (?:in)?to the public domain|is in the public domain",
    "reserved": r"\ball rights reserved\b",
}
RULES: list[tuple[str, tuple[str, ...]]] = [
    ("BSD-3-Clause", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.endorse", "bsd.asis")),
    ("BSD-2-Clause", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.asis")),
    ("Apache-2.0", ("apache2.name", "apache2.comply", "apache2.obtain", "apache2.asis")),
    ("AGPL-3.0", ("gpl.free", "agpl3.name", "gpl.warranty", "gpl.copy")),
    ("LGPL-3.0", ("gpl.free", "lgpl3.name", "gpl.warranty", "gpl.copy")),
    ("LGPL-2.1", ("gpl.free", "lgpl21.name", "gpl.warranty", "gpl.copy")),
    ("GPL-3.0", ("gpl.free", "gpl3.name", "gpl.warranty", "gpl.copy")),
    ("GPL-2.0", ("gpl.free", "gpl2.name", "gpl.warranty", "gpl.copy")),
    ("MIT", ("mit.name", "mit.grant", "mit.notice", "mit.asis")),
    ("MIT", ("mit.grant", "mit.notice", "mit.asis")),
    ("Unlicense", ("unlicense.grant", "unlicense.use")),
    ("ISC", ("isc.grant", "isc.asis")),
    ("Apache-2.0", ("apache2.name",)), ("MIT", ("mit.name",)), ("BSD", ("bsd.name",)),
    ("AGPL-3.0", ("agpl3.name",)), ("LGPL-3.0", ("lgpl3.name",)), ("LGPL-2.1", ("lgpl21.name",)), ("GPL-3.0", ("gpl3.name",)), ("GPL-2.0", ("gpl2.name",)),
    ("MPL-2.0", ("mpl2.name",)), ("CC0-1.0", ("cc0.name",)), ("CC-BY-NC-ND-4.0", ("ccbyncnd4.name",)), ("CC-BY-NC-SA-4.0", ("ccbyncsa4.name",)),
    ("CC-BY-NC-4.0", ("ccbync4.name",)), ("CC-BY-SA-4.0", ("ccbysa4.name",)), ("CC-BY-4.0", ("ccby4.name",)), ("Public-domain", ("public.domain",)),
    ("All-rights-reserved", ("reserved",)),
]
#: A single word of each sentence above, since line breaks and comment marks may stand between two; texts without any are not looked at further.
NEEDED = r"(?i:licen[sc]e|permission|redistribut|warrant|domain|reserved|anyone|endorse|cc0|creative|cc(?![a-z0-9]))"

_SENTENCE = re.compile(r"(?:[^.!?;\n]|[.!?;](?=\S)|\n(?!\s*\n))+[.!?;]*")
_PATTERNS = [(name, re.compile(p)) for name, p in SENTENCES.items()]
_NEEDED = re.compile(NEEDED)


def normalised(sentence: str) -> str:
    s = sentence.lower().replace("licence", "license")
    s = re.sub(r"copyright|\(c\)|©|\b(?:19|20)\d\d\b(?:\s*[-,]\s*(?:19|20)\d\d\b)*", lambda m: " copyright " if m[0] == "copyright" else " ", s)
    s = re.sub(r"(?<=\d)\.(?=\d)", "․", s)  # the point of a version number stays
    return re.sub(r"[^a-z0-9․]+", " ", s).replace("․", ".").strip()


def narrowed(sentence: str, pattern: re.Pattern) -> tuple[int, int]:
    """The lines of a sentence that its match needs: without a closing mark, lines before run into it."""
    cuts = [0, *(i + 1 for i, c in enumerate(sentence) if c == "\n")]
    low, high = 0, len(cuts) - 1
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if pattern.search(normalised(sentence[cuts[mid]:])) else (low, mid - 1)
    a, ends = cuts[low], [*(c - 1 for c in cuts[low + 1:]), len(sentence)]
    low, high = 0, len(ends) - 1
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if pattern.search(normalised(sentence[a:ends[mid]])) else (mid + 1, high)
    return a + len(sentence[a:]) - len(sentence[a:].lstrip()), ends[low]


def identified(text: str) -> list[tuple[str, int, int]]:
    """(identifier, start, end) of every known licence sentence, by place; a sentence may hold several."""
    out = []
    for m in _SENTENCE.finditer(text):
        if _NEEDED.search(m[0]):
            s = normalised(m[0])
            for _, name, p in sorted(((h.start(), name, p) for name, p in _PATTERNS if (h := p.search(s))), key=lambda x: x[:2]):
                a, b = narrowed(m[0], p)
                out.append((name, m.start() + a, m.start() + b))
    return out


def ruled(found: list[tuple[str, int, int]]) -> tuple[list[tuple[int, int, str]], int]:
    """(start, end, licence) for every rule that holds, and the number of identifiers that none has used."""
    left, out = list(range(len(found))), []
    for name, rule in RULES:
        taken: set[int] = set()
        for i in [i for i, x in enumerate(left) if found[x][0] == rule[0]]:
            used, j = [i], i
            for want in rule[1:]:
                j = next((x for x in range(j + 1, min(j + 2 + GAP, len(left))) if x not in taken and found[left[x]][0] == want), -1)
                if j < 0:
                    break
                used.append(j)
            if len(used) == len(rule) and i not in taken:
                out.append((found[left[i]][1], max(found[left[u]][2] for u in used), name))
                taken.update(used)
        left = [x for i, x in enumerate(left) if i not in taken]
    return sorted(out), len(left)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, licences, matches, n_sentences, n_unused of every row of `docs` (doc_id, text); one pass, no shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                found = identified(text) if text else []
                rules, unused = ruled(found)
                rows.append((",".join(dict.fromkeys(n for _, _, n in rules)), ",".join(f"{n}:{a}:{b}" for a, b, n in rules), len(found), unused))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64(), pa.int64()))]],
                                                 names=["doc_id", "licences", "matches", "n_sentences", "n_unused"])

    return docs.select(F.col("doc_id").cast("long"), F.when(F.col("text").rlike(NEEDED), F.col("text")).alias("text")).mapInArrow(
        run, "doc_id long, licences string, matches string, n_sentences long, n_unused long")


def query(spark, sf_dir: str) -> DataFrame:
    """The licences that every document states."""
    return scan(table(spark, sf_dir, "documents"))
