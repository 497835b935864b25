"""Texts of common licences, their standard notices and one-line references."""

import pkgutil

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including
without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY
KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR
ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE
FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS
OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT
OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: 1. Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must
reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution. """

_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission. """

_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY
DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""

_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors
be held liable for any damages arising from the use of this software. Permission is granted to anyone to
use this software for any purpose, including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented;
you must not claim that you wrote the original software. If you use this software in a product, an
acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source
versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""

_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any means."""

_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS
OF ANY KIND, either express or implied. See the License for the specific language governing permissions
and limitations under the License."""

_GPL_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version 3 of the License, or
(at your option) any later version. This program is distributed in the hope that it will be useful, but
WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU
General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""

_MPL_NOTICE = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""

_LGPL21_NOTICE = """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser
General Public License as published by the Free Software Foundation; either version 2.1 of the License, or
(at your option) any later version. This library is distributed in the hope that it will be useful, but
WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the
GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation,
Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA"""

_GPL2_NOTICE = """This program is free software; you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation; either version 2 of the License, or
(at your option) any later version. This program is distributed in the hope that it will be useful, but
WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU
General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51
Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."""

_UNLICENSE_REST = """ In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all
copyright interest in the software to the public domain. We make this dedication for the benefit of the
public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt
act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>"""


def _of_kind(kind: str) -> str:
    return " ".join(_GPL_NOTICE.split()).replace("General Public", f"{kind} General Public")


#: Words of references that name neither a licence nor its version.
PLAIN_WORDS = frozenset("released licensed distributed available this work project is are under the terms of a an into to in and license "
                        "licence identifier version international".split())

#: Names by which running text refers to a licence, and its SPDX identifiers.
_NAMES = {
    "MIT": ["MIT License", "MIT"],
    "ISC": ["ISC License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "BSD-2-Clause"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "BSD-3-Clause"],
    "Zlib": ["zlib License"],
    "Unlicense": ["Unlicense"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License, Version 2", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "MPL-2.0"],
    "CC0-1.0": ["CC0 1.0", "Creative Commons Zero v1.0 Universal", "CC0-1.0"],
}
for _name, _long, _short, _versions in (
        ("GPL", "GNU General Public License", "GPL", ("2.0", "3.0")), ("LGPL", "GNU Lesser General Public License", "LGPL", ("2.1", "3.0")),
        ("AGPL", "GNU Affero General Public License", "AGPL", ("3.0",))):
    _NAMES[_name] = [_long, f"GNU {_short}"]
    for _version in _versions:
        _plain = _version.removesuffix(".0")
        _NAMES[f"{_name}-{_version}"] = [
            f"{form} {v}" for form in (f"{_long}, version", _long, f"GNU {_short} version", f"GNU {_short}", f"{_short} version", _short)
            for v in dict.fromkeys((_plain, _version))] + [
            f"{form} v{v}" for form in (_long, f"GNU {_short}", _short) for v in dict.fromkeys((_plain, _version))] + [
            f"{_short}v{_plain}", f"GNU {_short}v{_plain}", f"{_short}-{_version}-only", f"{_short}-{_version}-or-later",
            f"version {_plain} of the {_long}"]
for _short, _long in (("BY", "Attribution"), ("BY-NC", "Attribution-NonCommercial"), ("BY-SA", "Attribution-ShareAlike"),
                      ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike")):
    _NAMES[f"CC-{_short}-4.0"] = [f"CC {_short} 4.0", f"Creative Commons {_long} 4.0 International License", f"Creative Commons {_long} 4.0"]

#: (licence, form, text), several forms for one licence.
TEMPLATES = [
    ("MIT", "text", _MIT_GRANT),
    ("MIT", "reference", "Released under the MIT License."),
    ("ISC", "text", _ISC),
    ("ISC", "reference", "Released under the ISC License."),
    ("BSD-2-Clause", "text", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", "text", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("Zlib", "text", _ZLIB),
    ("Unlicense", "text", _UNLICENSE),
    ("Apache-2.0", "notice", _APACHE_NOTICE),
    ("Apache-2.0", "reference", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "notice", _GPL_NOTICE),
    ("GPL-3.0", "reference", "This work is licensed under the GNU General Public License, version 3."),
    ("AGPL-3.0", "reference", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("LGPL-3.0", "reference", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "notice", _MPL_NOTICE),
    ("CC-BY-4.0", "reference", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "reference", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "reference", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-SA-4.0", "reference", "Licensed under CC BY-NC-SA 4.0."),
    ("CC0-1.0", "reference", "Released into the public domain under CC0 1.0."),
]
TEMPLATES += [
    ("Unlicense", "text", _UNLICENSE + _UNLICENSE_REST),
    ("GPL-2.0", "notice", _GPL2_NOTICE),
    ("GPL-2.0", "notice", _GPL_NOTICE.replace("version 3 ", "version 2 ")),
    ("GPL-3.0", "notice", _GPL2_NOTICE.replace("version 2 ", "version 3 ")),
    ("AGPL-3.0", "notice", _of_kind("Affero")),
    ("LGPL-2.1", "notice", _LGPL21_NOTICE),
    ("LGPL-3.0", "notice", _of_kind("Lesser")),
]
for _name, _listed in _NAMES.items():
    for _text in _listed:
        TEMPLATES += [(_name, "reference", f"{_way} {_text}") for _way in (
            "under the", "under the terms of the", "under", "SPDX-License-Identifier:")]
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software
and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is
furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including
the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in
whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of
machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY
OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR
PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE
FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

# The Affero licence is the GPL but for its names, the end of its preamble and section 13.
_AFFERO_PREAMBLE = """The GNU Affero General Public License is a free, copyleft license for software and other kinds of works,
specifically designed to ensure cooperation with the community in the case of network server software. """
_AFFERO_STEPS = """Developers that use our General Public Licenses protect your rights with two steps: (1) assert copyright on
the software, and (2) offer you this License which gives you legal permission to copy, distribute and/or modify the software.
A secondary benefit of defending all users' freedom is that improvements made in alternate versions of the program, if they
receive widespread use, become available for other developers to incorporate. Many developers of free software are heartened
and encouraged by the resulting cooperation. However, in the case of software used on network servers, this result may fail
to come about. The GNU General Public License permits making a modified version and letting the public access it on a server
without ever releasing its source code to the public. The GNU Affero General Public License is designed specifically to
ensure that, in such cases, the modified source code becomes available to the community. It requires the operator of a
network server to provide the source code of the modified version running there to the users of that server. Therefore,
public use of a modified version, on a publicly accessible server, gives the public access to the source code of the modified
version. The precise terms and conditions for copying, distribution and modification follow. """
_AFFERO_NETWORK = """13. Remote Network Interaction; Use with the GNU General Public License. Notwithstanding any other provision
of this License, if you modify the Program, your modified version must prominently offer all users interacting with it
remotely through a computer network (if your version supports such interaction) an opportunity to receive the Corresponding
Source of your version by providing access to the Corresponding Source from a network server at no charge, through some
standard or customary means of facilitating copying of software. This Corresponding Source shall include the Corresponding
Source for any work covered by version 3 of the GNU General Public License that is incorporated pursuant to the following
paragraph. Notwithstanding any other provision of this License, you have permission to link or combine any covered work with a
work licensed under version 3 of the GNU General Public License into a single combined work, and to convey the resulting
work. The terms of this License will continue to apply to the part which is the covered work, but the work with which it is
combined will remain governed by version 3 of the GNU General Public License. """


def _full(name: str) -> str:
    return pkgutil.get_data("almanac.llm", f"full_licenses/{name}.txt").decode()


def _affero(gpl: str) -> str:
    """The Affero licence, from the text of the GPL's third version."""
    head, terms = gpl.split("TERMS AND CONDITIONS", 1)
    opening = head[head.index("The licenses for most software"):head.index("Developers that use")]
    before, rest = terms.split("13. Use with the GNU Affero", 1)
    after = rest[rest.index("14. Revised"):]
    named = [part.replace("GNU General Public License", "GNU Affero General Public License") for part in (opening, before, after)]
    return " ".join(["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", _AFFERO_PREAMBLE, named[0], _AFFERO_STEPS,
                     "TERMS AND CONDITIONS", named[1], _AFFERO_NETWORK, named[2]])


TEMPLATES += [(_name, "text", _full(_file)) for _name, _file in (
    ("Apache-2.0", "Apache-2.0"), ("CC0-1.0", "CC0-1.0"), ("GPL-2.0", "GPL-2"), ("GPL-3.0", "GPL-3"), ("LGPL-2.1", "LGPL-2.1"),
    ("LGPL-3.0", "LGPL-3"), ("MPL-2.0", "MPL-2.0"))]
TEMPLATES += [(_name, "text", _full(_file)) for _name, _file in (
    ("Artistic-1.0", "Artistic-1.0"), ("GFDL-1.3", "GFDL-1.3"), ("GPL-1.0", "GPL-1"), ("LGPL-2.0", "LGPL-2"), ("MPL-1.1", "MPL-1.1"))]
TEMPLATES += [("BSL-1.0", "text", _BOOST), ("AGPL-3.0", "text", _affero(_full("GPL-3")))]
