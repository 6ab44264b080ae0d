"""[op 7] Wordings of public licences, as templates with markup (fixed values; what a text must say word for word).

``<<beginOptional>>`` ... ``<<endOptional>>`` stands around words that may be
missing, ``<<var;match="regex";words=n>>`` for one to n words that match.
"""

OPEN, CLOSE = "<<beginOptional>>", "<<endOptional>>"
YEAR = '<<var;match="[0-9]{4}";words=4>>'
NAME = '<<var;match=".+";words=8>>'
HOLDER = '<<var;match=".+";words=12>>'
UNDER = f'<<var;match="released|licensed|distributed|available|provided";words=1>> under {OPEN}the{CLOSE} {OPEN}terms of the{CLOSE}'
ITEM = f'{OPEN}<<var;match="[0-9a-z]";words=1>>{CLOSE}'
PROGRAM = '<<var;match="this|that|the|program|library|software|file|it";words=2>>'
LATER = f"of the License, or {OPEN}(at your option){CLOSE} any later version"

_AS_IS_BSD = (
    f'THIS SOFTWARE IS PROVIDED BY {HOLDER} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    f"IN NO EVENT SHALL {HOLDER} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_TWO = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    f"{ITEM} Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    f"{ITEM} Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_MIT_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, '
    "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    f"The above copyright notice and this permission notice {OPEN}(including the next paragraph){CLOSE} shall be included in all copies or substantial portions of the Software. "
)
_GPL_TAIL = (
    f"{PROGRAM} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
)

#: Labels and templates: short notices as people write them, then the texts.
TEMPLATES: list[tuple[str, str]] = [
    ("mit", f"{UNDER} MIT License"),
    ("apache-2.0", f"{UNDER} Apache License {OPEN},{CLOSE} Version 2.0"),
    ("gpl-2.0", f"{OPEN}GNU{CLOSE} General Public License {OPEN}as published by the Free Software Foundation; either{CLOSE} Version 2 {OPEN}{LATER}{CLOSE}"),
    ("gpl-3.0", f"{OPEN}GNU{CLOSE} General Public License {OPEN}as published by the Free Software Foundation, either{CLOSE} Version 3 {OPEN}{LATER}{CLOSE}"),
    ("lgpl", f'GNU Lesser General Public License {OPEN}as published by the Free Software Foundation; either{CLOSE} {OPEN}version <<var;match="[0-9]";words=2>>{CLOSE} {OPEN}{LATER}{CLOSE}'),
    ("agpl", f"GNU Affero General Public License {OPEN}as published by the Free Software Foundation, either{CLOSE} {OPEN}version 3{CLOSE} {OPEN}{LATER}{CLOSE}"),
    ("cc-by-4.0", f"{OPEN}licensed under{CLOSE} CC BY 4.0"),
    ("cc-by-nc-4.0", f"{OPEN}licensed under{CLOSE} CC BY NC 4.0"),
    ("cc-by-sa-4.0", f"{OPEN}licensed under{CLOSE} CC BY SA 4.0"),
    ("cc-by", f'Creative Commons Attribution <<var;match="[0-9]";words=2>> {OPEN}International{CLOSE} {OPEN}Public{CLOSE} License'),
    ("cc0", f'{OPEN}{UNDER}{CLOSE} CC0 1.0 {OPEN}Universal{CLOSE} {OPEN}Public Domain Dedication{CLOSE}'),
    ("copyright", f"Copyright {OPEN}(c){CLOSE} {YEAR} {NAME} All rights reserved"),
    ("mit", _MIT_GRANT),
    ("mit-text", _MIT_GRANT
     + 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
     f"IN NO EVENT SHALL {HOLDER} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("bsd", f"Redistribution and use in source and binary forms, with or without modification, are permitted {OPEN}(subject to the limitations in the disclaimer below){CLOSE} provided that the following conditions are met"),
    ("bsd-2-clause", _BSD_TWO + _AS_IS_BSD),
    ("bsd-3-clause", _BSD_TWO + f"{ITEM} Neither the name of {HOLDER} nor the names of {OPEN}its{CLOSE} {OPEN}their{CLOSE} contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _AS_IS_BSD),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc-text", f"Permission to use, copy, modify, {OPEN}and/or{CLOSE} {OPEN}and{CLOSE} distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
     f'THE SOFTWARE IS PROVIDED "AS IS" AND {HOLDER} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL {HOLDER} BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, '
     "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
     "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
     f"{ITEM} The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
     f"{ITEM} Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. {ITEM} This notice may not be removed or altered from any source distribution."),
    ("apache-2.0-notice", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
     f'{OPEN}<<var;match="https?";words=1>>{CLOSE} www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
     "See the License for the specific language governing permissions and limitations under the License."),
    ("mpl-2.0", f"This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. {OPEN}If a copy of the MPL was not distributed with this file, You can obtain one at <<var;match=\"https?\";words=1>> mozilla.org/MPL/2.0/{CLOSE}"),
    ("gpl-notice", f"{PROGRAM} is free software{OPEN};{CLOSE} you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version <<var;match=\"[23]\";words=1>> {LATER}. {_GPL_TAIL} General Public License for more details."),
    ("lgpl-notice", f"{PROGRAM} is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version <<var;match=\"[0-9]\";words=2>> {LATER}. {_GPL_TAIL} Lesser General Public License for more details."),
    ("agpl-notice", f"{PROGRAM} is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 {LATER}. {_GPL_TAIL} Affero General Public License for more details."),
    ("bsl-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"),
    ("unlicense", f"This is free and unencumbered software released into the public domain. {OPEN}Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.{CLOSE}"),
    ("wtfpl", f"Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. {OPEN}DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE{CLOSE} {OPEN}TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION{CLOSE} {OPEN}0.{CLOSE} You just DO WHAT THE FUCK YOU WANT TO"),
]
