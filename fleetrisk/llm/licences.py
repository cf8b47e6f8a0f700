"""Licence scans by sentence rules.

A text is cut into fragments at its line ends, at list marks and behind ``.!?;:``, and each is
normalised (lower case, runs of other characters than letters, digits, ``.`` and ``+`` become
one space, outer stops go; comment marks go with them). Known sentences are cut and normalised
alike. From every fragment on, the longest run of whole fragments whose words are a known
sentence is found in a tree of words, so neither line breaks nor stops inside a sentence
matter. A copyright notice up to its ``all rights reserved`` is a known sentence, whoever holds
the right. What is left is the text's sequence of sentence identifiers. Licence rules are
ordered sequences of identifiers; from left to right the longest rule that matches at a place
names a licence and uses up its sentences. ``all-rights`` right before a licence belongs to it.

Only texts with a trigger word are split at all; every known sentence holds one, so no match
is lost. Sentences of any length and whole texts are read.

Defined results. NULL, empty and other texts without a licence sentence give empty lists.
Sentences with a trigger word outside their known parts are counted as unknown; they end
behind ``.!?:`` (not behind ``v.``), at blank lines and at list items. Repeated rows are
judged alike. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRIGGER = r"licen[sc]|copyright|copyleft|warrant|redistribut|permission|public\W+domain"

#: Known sentences, normalised; several wordings may share an identifier.
SENTENCES = {
    "mit-released": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license",
                     "this software is released under the mit license", "this project is licensed under the terms of the mit license"],
    "mit-grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit-notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "as-is-warranty": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "isc-grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "apache-2-licensed": ["licensed under the apache license version 2.0", "licensed under the apache license version 2.0 the license",
                          "this project is licensed under the apache license version 2.0", "released under the apache license version 2.0"],
    "apache-2-comply": ["you may not use this file except in compliance with the license"],
    "apache-2-copy": ["you may obtain a copy of the license at", "you may obtain a copy of the license at http www.apache.org licenses license 2.0"],
    "apache-2-basis": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "gpl-3-work": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3",
                   "this program is licensed under the gnu general public license version 3"],
    "gpl-2-work": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2",
                   "this program is licensed under the gnu general public license version 2"],
    "gpl-3-redistribute": ["you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
                           "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "gpl-2-redistribute": ["you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
                           "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "lgpl-3-work": ["licensed under the gnu lesser general public license version 3", "this work is licensed under the gnu lesser general public license version 3"],
    "agpl-3-work": ["licensed under the gnu affero general public license version 3", "this work is licensed under the gnu affero general public license version 3"],
    "gpl-no-warranty": ["this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
                        "but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "bsd-redistribution": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd-source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd-binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd-endorse": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsd-3-licensed": ["licensed under the bsd 3 clause license", "released under the bsd 3 clause license", "licensed under the 3 clause bsd license"],
    "bsd-2-licensed": ["licensed under the bsd 2 clause license", "released under the bsd 2 clause license"],
    "mpl-2-subject": ["this source code form is subject to the terms of the mozilla public license v 2.0", "licensed under the mozilla public license version 2.0"],
    "cc-by-4": ["licensed under cc by 4.0", "this work is licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"],
    "cc-by-sa-4": ["licensed under cc by sa 4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license"],
    "cc-by-nc-4": ["licensed under cc by nc 4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 international license"],
    "cc-by-nc-sa-4": ["licensed under cc by nc sa 4.0"],
    "cc-by-nd-4": ["licensed under cc by nd 4.0"],
    "cc0": ["released under cc0 1.0 public domain dedication", "this work is dedicated to the public domain"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "all-rights": ["copyright all rights reserved"],
}

#: Licence rules: ordered sentence identifiers.
RULES = [
    ("MIT", ("mit-grant", "mit-notice", "as-is-warranty")), ("MIT", ("mit-grant", "mit-notice")), ("MIT", ("mit-released",)),
    ("ISC", ("isc-grant", "as-is-warranty")), ("ISC", ("isc-grant",)),
    ("Apache-2.0", ("apache-2-licensed", "apache-2-comply", "apache-2-copy", "apache-2-basis")), ("Apache-2.0", ("apache-2-licensed",)),
    ("GPL-3.0-or-later", ("gpl-3-redistribute", "gpl-no-warranty")), ("GPL-3.0-or-later", ("gpl-3-redistribute",)),
    ("GPL-2.0-or-later", ("gpl-2-redistribute", "gpl-no-warranty")), ("GPL-2.0-or-later", ("gpl-2-redistribute",)),
    ("GPL-3.0", ("gpl-3-work",)), ("GPL-2.0", ("gpl-2-work",)), ("LGPL-3.0", ("lgpl-3-work",)), ("AGPL-3.0", ("agpl-3-work",)),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("bsd-3-licensed",)), ("BSD-2-Clause", ("bsd-2-licensed",)), ("MPL-2.0", ("mpl-2-subject",)),
    ("CC-BY-4.0", ("cc-by-4",)), ("CC-BY-SA-4.0", ("cc-by-sa-4",)), ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-4",)), ("CC-BY-ND-4.0", ("cc-by-nd-4",)), ("CC0-1.0", ("cc0",)),
    ("Unlicense", ("unlicense",)), ("LicenseRef-Proprietary", ("all-rights",)),
]

RULES += [(licence, ("all-rights", *ids)) for licence, ids in RULES if ids != ("all-rights",)]

_STOP = re.compile(r"(?<=[.!?;:])\s+")
_SENTENCE_END = re.compile(r"(?<!\bv\.)(?<=[.!?:])$", re.IGNORECASE)
#: A list mark with a bracket (one with a stop is cut off as a fragment anyhow) or a comment mark made of letters.
_MARK = re.compile(r"[^\w\n]*(?:\(?(?:\d{1,2}|[a-z]|[ivx]{1,4})\)|(dnl|rem)\b)\s+", re.IGNORECASE)
_OTHER = re.compile(r"[^a-z0-9.+]+")
_TRIGGER = re.compile(TRIGGER)
_YEAR = re.compile(r"(?:19|20)\d\d")
_RESERVED = ["all", "rights", "reserved"]
#: Most words from a copyright mark to its "all rights reserved".
_NOTICE_WORDS = 60
_FIRST = {}
for _licence, _ids in sorted(RULES, key=lambda rule: -len(rule[1])):
    _FIRST.setdefault(_ids[0], []).append((_licence, _ids))


def normalise(sentence: str) -> str:
    return _OTHER.sub(" ", sentence.lower()).strip(" .+")


def fragments(text: str) -> list[tuple[list[str], str, int]]:
    """(words, lower-case text, sentence) of every fragment; the sentences are numbered from 1, paragraphs apart by 2 or more."""
    out, sentence = [], 1
    for line in text.split("\n"):
        if not normalise(line):
            sentence += 2
            continue
        mark = _MARK.match(line)
        if mark and mark.end() < len(line):
            sentence += not mark[1]
            line = line[mark.end():]
        for part in _STOP.split(line.strip()):
            words = normalise(part).split()
            if words:
                out.append((words, part.lower(), sentence))
            sentence += bool(_SENTENCE_END.search(part))
    return out


_TREE: dict = {}
for _name, _wordings in SENTENCES.items():
    for _wording in _wordings:
        _node = _TREE
        for _words, _, _ in fragments(_wording):
            for _word in _words:
                _node = _node.setdefault(_word, {})
        _node[None] = _name


def _known(parts: list, at: int) -> tuple[str | None, int]:
    """The longest known sentence from fragment ``at`` on, and the fragment behind it."""
    node, found = _TREE, (None, at)
    for k in range(at, len(parts)):
        for word in parts[k][0]:
            node = node.get(word)
            if node is None:
                return found
        if None in node:
            found = node[None], k + 1
    return found


def _notice(parts: list, at: int) -> int:
    """The fragment behind a copyright notice that ends in "all rights reserved"; ``at`` if there is none."""
    if "copyright" not in parts[at][0][:3]:
        return at
    words: list[str] = []
    for k in range(at, len(parts)):
        if k > at and (parts[k][2] > parts[k - 1][2] + 1 or _known(parts, k)[0]):
            return at
        words += parts[k][0]
        if words[-3:] == _RESERVED:
            marked = parts[k][0] == _RESERVED or "c" in words or "\u00a9" in parts[at][1] or any(map(_YEAR.match, words))
            return k + 1 if marked else at
        if len(words) > _NOTICE_WORDS:
            return at
    return at


def sentence_ids(text: str) -> tuple[list[str], int]:
    """Identifiers of the text's known licence sentences in order, and the number of unknown ones."""
    parts = fragments(text)
    ids, rest, at = [], {}, 0
    while at < len(parts):
        name, end = _known(parts, at)
        if name is None and (end := _notice(parts, at)) > at:
            name = "all-rights"
        if name:
            ids.append(name)
            at = end
        else:
            rest.setdefault(parts[at][2], []).append(parts[at][1])
            at += 1
    return ids, sum(bool(_TRIGGER.search(" ".join(part))) for part in rest.values())


def match_rules(ids: list[str]) -> list[str]:
    """Licences in order of their first sentence; a sentence counts for one rule."""
    found, at = [], 0
    while at < len(ids):
        for licence, rule in _FIRST.get(ids[at], ()):
            if tuple(ids[at:at + len(rule)]) == rule:
                found.append(licence)
                at += len(rule) - 1
                break
        at += 1
    return found


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column("text")
        may = pc.fill_null(pc.match_substring_regex(text, TRIGGER, ignore_case=True), False).to_numpy(zero_copy_only=False)
        ids, licences, unknown = [[]] * len(text), [[]] * len(text), [0] * len(text)
        for k in may.nonzero()[0]:
            ids[k], unknown[k] = sentence_ids(text[k].as_py())
            licences[k] = match_rules(ids[k])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(ids, pa.list_(pa.string())), pa.array(unknown, pa.int64()),
             pa.array([sorted(set(x)) for x in licences], pa.list_(pa.string()))],
            names=["doc_id", "sentence_ids", "unknown_sentences", "licences"])


def scan_licences(documents: DataFrame) -> DataFrame:
    """Per document row: known sentences in order, unknown ones, licences (sorted, once each)."""
    frame = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return frame.mapInArrow(_scan, "doc_id bigint, sentence_ids array<string>, unknown_sentences bigint, licences array<string>")
