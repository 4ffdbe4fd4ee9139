"""What the license scan covers: notices, full texts, one-line wordings, and the words that decide between siblings."""

from __future__ import annotations

from functools import lru_cache
from itertools import product

from lodeseam.llm.license_texts import full_texts

_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software '
    "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies "
    'or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
    'permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES '
    "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS "
    "OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_BINARY = (
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials "
    "provided with the distribution."
)
_BSD_NAME = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_ADVERT = "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization."
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GNU = (("GPL", "General", ("1", "2", "3")), ("LGPL", "Library General", ("2",)), ("LGPL", "Lesser General", ("2.1", "3")), ("AGPL", "Affero General", ("3",)))
_FREE = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} Public License"


def _full(version: str) -> str:
    return version if "." in version else f"{version}.0"


@lru_cache(1)
def notices() -> tuple[dict[str, str], dict[str, tuple[str, ...]]]:
    """Texts by SPDX identifier (":" tells texts of one license apart), and for some the words of which all must occur as they are."""
    texts = {f"{spdx}:text": text for spdx, text in full_texts().items()}
    # only where a sibling that is not among the texts would be contained as well: AGPL, GFDL 1.1
    deciding: dict[str, tuple[str, ...]] = {"GPL-3.0:text": ("Use with the GNU Affero General Public License",)}
    deciding |= {f"GFDL-{v}:text": (f"GNU Free Documentation License Version {v}",) for v in ("1.2", "1.3")}
    for spdx, kind, versions in _GNU:
        for v in versions:
            name, free = f"{spdx}-{_full(v)}", _FREE.format(kind=kind)
            texts[f"{name}:header"] = f"{free} as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version."
            deciding[f"{name}:header"] = (f"GNU {kind} Public License", f"version {v} of the License")
            texts[f"{name}:only"] = f"{free} as published by the Free Software Foundation, version {v}."
            deciding[f"{name}:only"] = (f"GNU {kind} Public License", f"Foundation version {v}")
            texts[f"{name}:only2"] = f"{free} version {v} as published by the Free Software Foundation."
            deciding[f"{name}:only2"] = (f"GNU {kind} Public License version {v} as",)
    apache = (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
    )
    texts["Apache-2.0:header"], deciding["Apache-2.0:header"] = apache, ("Apache License Version 2.0 the",)
    for v in ("1.1", "2.0"):
        mpl = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0." if v == "2.0" else (
            'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License.'
        )
        texts[f"MPL-{v}:header"], deciding[f"MPL-{v}:header"] = mpl, (f"Mozilla Public License {'v' if v == '2.0' else 'version'} {v}",)
    texts["MIT:header"], texts["MIT:text"] = _MIT[: _MIT.index(", subject to")], _MIT
    texts["ISC:header"], texts["ISC:text"] = _ISC[: _ISC.index(" THE SOFTWARE")], _ISC
    texts["BSD:header"] = _BSD  # the clauses after it decide which
    # the clauses may be numbered, which only changes the shingles across their borders
    texts["BSD-2-Clause:text"] = f"{_BSD}: 1. {_BSD_SOURCE} 2. {_BSD_BINARY} {_BSD_END}"
    texts["BSD-3-Clause:text"] = f"{_BSD}: 1. {_BSD_SOURCE} 2. {_BSD_BINARY} 3. {_BSD_NAME} {_BSD_END}"
    texts["BSD-4-Clause:text"] = f"{_BSD}: 1. {_BSD_SOURCE} 2. {_BSD_BINARY} 3. {_BSD_ADVERT} 4. {_BSD_NAME} {_BSD_END}"
    deciding["BSD-3-Clause:text"] = ("endorse or promote products derived from this software",)
    deciding["BSD-4-Clause:text"] = ("all advertising materials mentioning features", "endorse or promote products derived from this software")
    texts["Unlicense:header"] = (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in "
        "source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    )
    texts["Zlib:header"] = (
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"
    )
    texts["BSL-1.0:header"] = (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"
    )
    return texts, deciding


_VERBS = ("licensed", "licenced", "released", "distributed", "redistributed", "published", "available", "provided", "offered", "issued", "shared", "covered", "placed", "contributed", "dual licensed")
_TERMS = ("the terms of", "the terms and conditions of", "the conditions of", "terms of")
LEADS = (
    *(f"{v} under" for v in _VERBS), *(f"{v} under {t}" for v, t in product(_VERBS, _TERMS)), *(f"under {t}" for t in _TERMS), *(f"subject to {t}" for t in _TERMS),
    "subject to", "covered by", "governed by", "is under", "are under", "spdx license identifier", "license osi approved", "license", "licence",
)
ARTICLES = ("the", "a", "an")


@lru_cache(1)
def names() -> dict[str, str]:
    """What licenses are called after a LEAD, and their SPDX identifiers; without a version, that of the family."""
    out: dict[str, str] = {}

    def add(spdx: str, *spoken: str) -> None:
        for name in spoken:
            for license in {"license", "licence"}:
                out.setdefault(name.replace("license", license), spdx)

    def family(spdx: str, versions: tuple[str, ...], *spoken: str, versioned=None) -> None:
        for name in spoken:
            add(spdx, name)
            for v in versions:
                whole = (versioned or "{}-{}").format(spdx, _full(v))
                for said in {v, _full(v), v.removesuffix(".0")}:
                    add(whole, f"{name} {said}", f"{name} version {said}", f"{name} v{said}", f"{name} v {said}", f"version {said} of the {name}", f"v{said} of the {name}")
                    if " " not in name:
                        add(whole, f"{name}v{said}", f"{name}{said}")
                    if "license" not in name:
                        add(whole, f"{name} license {said}", f"{name} license version {said}", f"{name} license v{said}")

    family("Apache", ("1.0", "1.1", "2.0"), "apache license", "apache software license", "apache public license", "asf license", "apache", "asl")
    for spdx, kind, _ in _GNU:
        versions = {"GPL": ("1", "2", "3"), "LGPL": ("2", "2.1", "3"), "AGPL": ("1", "3")}[spdx]
        family(spdx, versions, f"gnu {kind.lower()} public license", f"{kind.lower()} public license", f"gnu {spdx.lower()}", spdx.lower())
    family("LGPL", ("2", "2.1", "3"), "gnu lesser gpl", "lesser gpl")
    family("AGPL", ("1", "3"), "gnu affero gpl", "affero gpl")
    family("GFDL", ("1.1", "1.2", "1.3"), "gnu free documentation license", "free documentation license", "gnu fdl", "gfdl")
    family("MPL", ("1.0", "1.1", "2.0"), "mozilla public license", "mpl")
    family("EPL", ("1.0", "2.0"), "eclipse public license", "epl")
    family("EUPL", ("1.1", "1.2"), "european union public license", "eupl")
    family("CDDL", ("1.0", "1.1"), "common development and distribution license", "cddl")
    family("Artistic", ("1.0", "2.0"), "artistic license", "artistic")
    family("BSL-1.0", (), "boost software license", "boost license", "bsl 1.0")
    add("MIT", "mit", "mit license", "mit x11 license", "expat license", "expat")
    add("X11", "x11 license", "x11")
    add("ISC", "isc", "isc license")
    add("BSD", "bsd", "bsd license", "bsd style license", "berkeley software distribution license")
    add("0BSD", "0bsd", "zero clause bsd")
    for n, word, also in (("2", "two", ("simplified", "freebsd")), ("3", "three", ("new", "modified", "revised")), ("4", "four", ("original", "old"))):
        spdx = f"BSD-{n}-Clause"
        for c in (f"{n} clause", f"{word} clause"):
            add(spdx, f"bsd {c}", f"{c} bsd", f"bsd license {c}")
        for c in also:
            add(spdx, "freebsd license" if c == "freebsd" else f"{c} bsd")
    add("Unlicense", "unlicense", "un license")
    add("Zlib", "zlib license", "zlib libpng license", "zlib")
    add("WTFPL", "wtfpl", "do what the fuck you want to public license")
    add("CC0-1.0", "cc0", "cc 0", "creative commons zero", "creative commons cc0", "creative commons 0")
    elements = {"nc": ("noncommercial", "non commercial"), "sa": ("sharealike", "share alike"), "nd": ("noderivatives", "no derivatives", "noderivs", "no derivs")}
    for kind in ((), ("sa",), ("nc",), ("nd",), ("nc", "sa"), ("nc", "nd")):
        spdx = "-".join(("CC", "BY", *(k.upper() for k in kind)))
        spoken = [f"cc by {' '.join(kind)}".strip(), f"creative commons by {' '.join(kind)}".strip()]
        spoken += [f"{cc} attribution {' '.join(x)}".strip() for cc in ("creative commons", "cc") for x in product(*(elements[k] for k in kind))]
        for name in spoken:
            add(spdx, name)
            for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
                for said in {v, v.removesuffix(".0")}:
                    for middle in ("", " license", " international", " international license", " international public license", " unported", " unported license", " version", " license version", " v"):
                        add(f"{spdx}-{v}", f"{name}{middle} {said}")
                    add(f"{spdx}-{v}", f"{name} v{said}", f"{name} license v{said}", f"{name}{said}" if " by" not in name else f"{name} {said}")
    return out
