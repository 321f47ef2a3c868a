"""License texts and notices as templates: fixed values, label and marked-up text.

<<beginOptional>> ... <<endOptional>> may be left out as a whole; <<var;name="...";words="a-b">> stands
for any a to b words; <<var;name="...";match="x|y">> for one of the given wordings. All else is
mandatory, word by word; case, white space and punctuation do not count.
"""

_COPYRIGHT = '<<beginOptional>>Copyright <<var;name="copyright";words="1-30">><<endOptional>><<beginOptional>>All rights reserved.<<endOptional>>'
_BSD_CONDITIONS = """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
<<var;name="bullet";match="1|a|">> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
<<var;name="bullet";match="2|b|">> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_DISCLAIMER = """
THIS SOFTWARE IS PROVIDED BY <<var;name="who";words="1-20">> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;name="who";words="1-20">> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
_WORK = '<<beginOptional>><<var;name="work";match="this work is|this file is|this program is|this software is|this text is">><<endOptional>>'

TEMPLATES = (
    ("mit", f"""<<beginOptional>><<beginOptional>>The<<endOptional>> MIT License<<beginOptional>>(MIT)<<endOptional>><<endOptional>> {_COPYRIGHT}
Permission is hereby granted, free of charge, to any person obtaining a copy of <<var;name="files";match="this software and associated documentation files|this software and its associated documentation files">> (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;name="holder";words="1-20">> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("mit", '<<var;name="verb";match="released|licensed|distributed|available">> under the <<beginOptional>>terms of the<<endOptional>> MIT License'),
    ("bsd-2-clause", f"{_COPYRIGHT}{_BSD_CONDITIONS}{_BSD_DISCLAIMER}"),
    ("bsd-3-clause", f"""{_COPYRIGHT}{_BSD_CONDITIONS}
<<var;name="bullet";match="3|c|">> Neither the name of <<var;name="organisation";words="1-20">> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
{_BSD_DISCLAIMER}"""),
    ("isc", f"""<<beginOptional>>ISC License<<endOptional>> {_COPYRIGHT}
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND <<var;name="holder";words="1-10">> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;name="holder";words="1-10">> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("zlib", f"""<<beginOptional>>zlib License<<endOptional>> {_COPYRIGHT}
This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
<<beginOptional>>1.<<endOptional>> The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
<<beginOptional>>2.<<endOptional>> Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
<<beginOptional>>3.<<endOptional>> This notice may not be removed or altered from any source distribution."""),
    ("unlicense", """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
<<beginOptional>><<var;name="address";match="http|https">>://www.apache.org/licenses/LICENSE-2.0<<beginOptional>>.txt<<endOptional>><<endOptional>>
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("apache-2.0", '<<var;name="verb";match="licensed|released|distributed">> under the <<beginOptional>>terms of the<<endOptional>> Apache License, <<beginOptional>>Version<<endOptional>> 2.0'),
    ("gpl-2.0-or-later", """<<var;name="program";words="1-10">> is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.
<<beginOptional>><<var;name="program";words="1-10">> is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.<<endOptional>>"""),
    ("gpl-3.0-or-later", """<<var;name="program";words="1-10">> is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
<<beginOptional>><<var;name="program";words="1-10">> is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.<<endOptional>>"""),
    ("gpl-2.0", f'{_WORK} <<var;name="verb";match="licensed|released|distributed">> under <<beginOptional>>the terms of<<endOptional>> the GNU General Public License <<var;name="version";match="version 2|v2|2 0|version 2 0">>'),
    ("gpl-3.0", f'{_WORK} <<var;name="verb";match="licensed|released|distributed">> under <<beginOptional>>the terms of<<endOptional>> the GNU General Public License <<var;name="version";match="version 3|v3|3 0|version 3 0">>'),
    *((f"cc-{kind.replace(' ', '-')}-4.0", f'{_WORK} licensed under <<beginOptional>>a Creative Commons<<endOptional>> <<var;name="name";match="cc|">> {kind} <<beginOptional>>License<<endOptional>> 4.0') for kind in ("by", "by nc", "by sa", "by nd", "by nc sa", "by nc nd")),
)
