from runlens.llm import license_rules as lr


def test_rules_in_order():
    find = lr.RuleScan()
    apache = 'Licensed under the Apache License, Version 2.0 (the "License");'
    assert [x[0] for x in find("Licensed under the Apache License, Version 2.0.\nfoo")] == ["Apache-2.0"]
    full = apache + " x.\nYou may not use this file except in compliance with the License. You may obtain a copy of the License at."
    assert [x[0] for x in find(full.replace("(the", "the").replace(";", "."))] == ["Apache-2.0"]
    assert find("This program is free software. bla") == []
    far = "This program is free software. " + "bla. " * 9 + "You can redistribute it and/or modify it under the terms of the GNU General Public License."
    assert find(far) == []
    assert [x[0] for x in find(far.replace("bla. " * 9, "bla. "))] == ["GPL"]
    assert [x[0] for x in find("It is licensed under the MIT License of ours.\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0.")] == ["MIT", "CC-BY-NC-4.0"]


def brute(text):
    """Rules of one sentence only, by looking at every line."""
    lines = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
             "Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0"}
    return sorted({name for line, name in lines.items() if line in (text or "").split("\n")})


def test_tables(spark, docs_of, edges):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: [x for x in r["licenses"] if x != "proprietary"] for r in lr.scan(docs).collect()}
    assert got == {r["doc_id"]: brute(r["text"]) for r in docs.select("doc_id", "text").collect()}
    odd = lr.scan(docs_of(edges + [(8, "Released under the MIT License.\n" * 2)]).withColumnRenamed("lang", "licenses")).collect()
    assert len(odd) == len(edges) + 1 and [r["licenses"] for r in odd if r["doc_id"] == 8] == [["MIT"]]
    assert [len(r["spans"]) for r in odd if r["doc_id"] == 8] == [2] and all(not r["licenses"] for r in odd if r["doc_id"] != 8)
    assert lr.scan(docs_of([])).collect() == []


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
ENDORSE = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
MPL = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed"
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at
"""


def forms(text):
    """As published, in one line per paragraph, and as a comment in three styles."""
    yield text
    yield "\n\n".join(" ".join(p.split()) for p in text.split("\n\n"))
    for mark in ("# ", "// ", " * "):
        yield "".join(mark + line + "\n" for line in text.split("\n"))


def test_published_texts():
    find = lr.RuleScan()
    for text, name in ((MIT, "MIT"), (BSD, "BSD-2-Clause"), (BSD + ENDORSE, "BSD-3-Clause"), (MPL, "MPL-2.0"), (GPL, "GPL-3.0-or-later"), (APACHE, "Apache-2.0")):
        for form in forms(text):
            assert [x[0] for x in find(form)] == [name], (name, form)
    assert [x[0] for x in find("// SPDX-License-Identifier: BSD-3-Clause\nint x;")] == ["BSD-3-Clause"]
    assert find("Permission is hereby granted,\n\nfree of charge, to any person obtaining a copy of this software") == []
    assert find("SPDX-License-Identifier: MIT AND something else") == [] and find(GPL.replace("version 3", "version 9")) == []
