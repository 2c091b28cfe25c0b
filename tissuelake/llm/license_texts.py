"""License notices, file headers, headings and whole texts by SPDX identifier. The public wording of each license."""

_AS_IS = """IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution."""

_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_GNU_HEADER = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation,
either version {v} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received a copy of the GNU {name} along with
this program. If not, see <https://www.gnu.org/licenses/>."""

_GNU_SHORT = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation,
either version {v} of the License, or (at your option) any later version."""

_GNU_ONLY = """This {work} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} version {v} as published by the Free Software
Foundation."""

_GNU_ONLY_HEADER = """This {work} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation;
version {v} of the License. This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received a copy of the GNU {name} along with this {work}; if not, write to the Free
Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA"""

_GNU_HEADING = """GNU {NAME} Version {v}, {date} Copyright (C) {year} Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim
copies of this license document, but changing it is not allowed."""

TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License
at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    ],
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License - see the LICENSE file for details.",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the
Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software. THE SOFTWARE """ + _AS_IS,
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the
Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
permit persons to whom the Software is furnished to do so, subject to the following conditions:""",
    ],
    "ISC": [
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and
this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING
FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE.""",
    ],
    "BSD-2-Clause": [_BSD_HEAD + _BSD_TAIL],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        _BSD_HEAD
        + """ 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific
prior written permission. """
        + _BSD_TAIL,
    ],
    "CC-BY-4.0": ["Licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "Licensed under a Creative Commons Attribution NonCommercial 4.0 International License."],
    "GPL-2.0-or-later": [t.format(name="General Public License", v="2") for t in (_GNU_HEADER, _GNU_SHORT)] + ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "GPL-2.0-only": [t.format(work="program", name="General Public License", v="2") for t in (_GNU_ONLY, _GNU_ONLY_HEADER)],
    "LGPL-2.1-only": [t.format(work="library", name="Lesser General Public License", v="2.1") for t in (_GNU_ONLY, _GNU_ONLY_HEADER)],
    "LGPL-2.1-or-later": [t.format(name="Lesser General Public License", v="2.1").replace("program", "library") for t in (_GNU_HEADER, _GNU_SHORT)]
    + ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc."],
    "GPL-3.0-only": ["This work is licensed under the GNU General Public License, version 3."],
    "GPL-3.0-or-later": [t.format(name="General Public License", v="3") for t in (_GNU_HEADER, _GNU_SHORT)] + [_GNU_HEADING.format(NAME="GENERAL PUBLIC LICENSE", v="3", date="29 June 2007", year="2007")],
    "LGPL-3.0-only": ["This library is licensed under the GNU Lesser General Public License, version 3."],
    "LGPL-3.0-or-later": [_GNU_HEADER.format(name="Lesser General Public License", v="3"), _GNU_HEADING.format(NAME="LESSER GENERAL PUBLIC LICENSE", v="3", date="29 June 2007", year="2007")],
    "AGPL-3.0-or-later": [_GNU_HEADER.format(name="Affero General Public License", v="3"), _GNU_HEADING.format(NAME="AFFERO GENERAL PUBLIC LICENSE", v="3", date="19 November 2007", year="2007")],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
https://mozilla.org/MPL/2.0/.""",
        "Mozilla Public License Version 2.0 1. Definitions",
    ],
    "Unlicense": [
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either
in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    ],
}

#: Words that tell licenses of like wording apart: a piece needs those of its template, and in notices that name a family of licenses it may not have the others of RIVALS.
DECISIVE = ("affero", "apache", "bsd", "lesser", "later", "mit", "mozilla", "nc", "noncommercial", "spdx")
RIVALS = ("affero", "lesser", "later", "nc", "noncommercial")
FAMILIES = ("cc", "creative", "gnu", "spdx")

for _name, _texts in TEMPLATES.items():
    _texts.append(f"SPDX-License-Identifier: {_name}")
