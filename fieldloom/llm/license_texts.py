"""Licence texts and notices that the scan looks for (fixed values), as they are printed.

Each has a label, the text, and its mandatory key phrases: groups of alternatives, of each of which one must stand near the aligned words.
"""

MIT = """MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction,
including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES"""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
APACHE_HEAD = "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"
_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {0} for more details. You should have received a copy of the {0} along with this program. If not, see"""
GPL_3_HEAD = "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The GNU General Public License is a free, copyleft license for software and other kinds of works."
GPL_2_HEAD = "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The licenses for most software are designed to take away your freedom to share and change it."
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"""
BOOST = "Boost Software License Version 1.0 August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"

_GPL, _LGPL, _AGPL = "gnu general public license", "gnu lesser general public license", "gnu affero general public license"
_V = lambda n: [f"version {n}", f"v{n}", f"v {n}", f"gplv{n}"]
TEMPLATES = [
    ("mit", MIT, [["permission is hereby granted free of charge to any person obtaining a copy of this software", "mit license", "the above copyright notice and this permission notice shall be included in all copies or substantial portions"]]),
    ("mit", "released under the MIT License", [["mit license"]]),
    ("mit", "licensed under the terms of the MIT License", [["mit license"]]),
    ("bsd", BSD, [["redistribution and use in source and binary forms", "redistributions of source code must retain", "redistributions in binary form must reproduce"]]),
    ("bsd", "licensed under the 3 clause BSD license", [["bsd license"]]),
    ("isc", ISC, [["permission to use copy modify and or distribute this software for any purpose with or without fee", "permission to use copy modify and distribute this software for any purpose with or without fee"]]),
    ("apache-2", APACHE_NOTICE, [["apache license", "in compliance with the license"]]),
    ("apache-2", APACHE_HEAD, [["apache license version 2 0"]]),
    ("apache-2", "licensed under the Apache License, Version 2.0", [["apache license version 2"]]),
    ("apache-2", "released under version 2.0 of the Apache License", [["version 2 0 of the apache license"]]),
    ("gpl-3", _GNU.format("GNU General Public License", "3"), [[_GPL], _V(3)]),
    ("gpl-3", GPL_3_HEAD, [[_GPL], _V(3)]),
    ("gpl-3", "this work is licensed under the GNU General Public License, version 3", [[_GPL], ["version 3"]]),
    ("gpl-2", _GNU.format("GNU General Public License", "2"), [[_GPL], _V(2)]),
    ("gpl-2", GPL_2_HEAD, [[_GPL], _V(2)]),
    ("gpl-2", "this work is licensed under the GNU General Public License, version 2", [[_GPL], ["version 2"]]),
    ("lgpl", _GNU.format("GNU Lesser General Public License", "3"), [[_LGPL]]),
    ("lgpl", "licensed under the GNU Lesser General Public License", [[_LGPL]]),
    ("agpl-3", _GNU.format("GNU Affero General Public License", "3"), [[_AGPL]]),
    ("agpl-3", "licensed under the GNU Affero General Public License", [[_AGPL]]),
    ("mpl-2", MPL, [["mozilla public license"]]),
    ("unlicense", UNLICENSE, [["free and unencumbered software", "unencumbered software released into the public domain"]]),
    ("zlib", ZLIB, [["permission is granted to anyone to use this software for any purpose"]]),
    ("boost", BOOST, [["boost software license", "any person or organization obtaining a copy of the software"]]),
    ("cc-by-nc", "licensed under CC BY NC 4.0", [["cc by nc"]]),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", [["creative commons attribution noncommercial"]]),
    ("cc-by-sa", "licensed under CC BY SA 4.0", [["cc by sa"]]),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", [["creative commons attribution sharealike"]]),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License", [["creative commons attribution 4 0"]]),
    ("cc0", "dedicated to the public domain under CC0 1.0 Universal", [["cc0 1 0"]]),
    ("proprietary", "all rights reserved", [["all rights reserved"]]),
]
