"""Wordings of licences. All of them are the published texts, by SPDX name.

NAMES are what a licence is called; TEXTS are its grant and conditions or its standard notice, one string per
clause; DISCLAIMERS are clauses that may follow a text and are no condition for naming it.
"""

PRIVATE = "Private"

NAMES: dict[str, list[str]] = {
    "MIT": ["MIT License", "The MIT License (MIT)", "MIT/Expat licence", "Expat License", "license MIT", "MIT"],
    "Apache-2.0": ["Apache-2.0", "Apache License, Version 2.0", "Apache License 2.0", "Apache Software License 2.0", "ASL 2.0", "Apache 2"],
    "BSD-2-Clause": ["BSD-2-Clause", "BSD 2-Clause License", "Simplified BSD License", "two-clause BSD license", "FreeBSD License"],
    "BSD-3-Clause": ["BSD-3-Clause", "BSD 3-Clause License", "New BSD License", "Modified BSD License", "Revised BSD License", "three-clause BSD license"],
    "MPL-2.0": ["MPL-2.0", "Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "MPL 2"],
    "MPL-1.1": ["MPL-1.1", "Mozilla Public License 1.1", "Mozilla Public License, v. 1.1"],
    "GPL-3.0": ["GPL-3.0", "GPL v3", "GNU GPL version 3", "GNU General Public License v3", "GNU General Public License 3.0", "GPL version 3", "GPL 3"],
    "GPL-2.0": ["GPL-2.0", "GPL v2", "GNU GPL version 2", "GNU General Public License v2", "GPL version 2", "GPL 2"],
    "LGPL-3.0": ["LGPL-3.0", "LGPL v3", "GNU Lesser General Public License v3", "GNU LGPL version 3"],
    "LGPL-2.1": ["LGPL-2.1", "LGPL v2.1", "GNU Lesser General Public License v2.1", "GNU LGPL version 2.1"],
    "AGPL-3.0": ["AGPL-3.0", "AGPL v3", "GNU Affero General Public License v3", "GNU AGPL version 3"],
    "CC-BY-3.0": ["CC-BY-3.0", "Creative Commons Attribution 3.0", "CC-BY 3.0 Unported", "Attribution 3.0 Unported"],
    "CC-BY-4.0": ["CC-BY-4.0", "Creative Commons Attribution 4.0", "Attribution 4.0 International"],
    "CC-BY-SA-3.0": ["CC-BY-SA-3.0", "Creative Commons Attribution-ShareAlike 3.0"],
    "CC-BY-SA-4.0": ["CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0"],
    "CC-BY-NC-4.0": ["CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0"],
    "CC0-1.0": ["CC0-1.0", "CC0 1.0 Universal", "CC0"],
    "Unlicense": ["The Unlicense"],
    "ISC": ["ISC License", "license ISC"],
    "Zlib": ["zlib License", "license Zlib"],
    "BSL-1.0": ["BSL-1.0", "Boost Software License 1.0"],
    "OFL-1.1": ["OFL-1.1", "SIL Open Font License 1.1"],
    "EPL-2.0": ["EPL-2.0", "Eclipse Public License 2.0", "Eclipse Public License v. 2.0"],
    "EPL-1.0": ["EPL-1.0", "Eclipse Public License 1.0", "Eclipse Public License v1.0"],
    "EUPL-1.2": ["EUPL-1.2", "EUPL 1.2", "European Union Public Licence v. 1.2"],
    "Artistic-2.0": ["Artistic-2.0", "Artistic License 2.0"],
    "WTFPL": ["WTFPL", "Do What The F*ck You Want To Public License", "Do What The Fuck You Want To Public License"],
    PRIVATE: ["LicenseRef-User-Owned-Private", "All rights reserved", "proprietary", "internal use only", "not for redistribution"],
}

_GNU = (
    "{it} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the "
    "Free Software Foundation, either version {v} of the License, or (at your option) any later version."
)

TEXTS: dict[str, list[list[str]]] = {
    "MIT": [
        ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
        [
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
            '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
            "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
            "subject to the following conditions:",
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        ],
    ],
    "BSD-2-Clause": [
        [
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
            "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
            "documentation and/or other materials provided with the distribution.",
        ],
    ],
    "BSD-3-Clause": [
        ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"],
        [
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
            "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
            "documentation and/or other materials provided with the distribution.",
            "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
            "software without specific prior written permission.",
        ],
    ],
    "ISC": [
        [
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
            "above copyright notice and this permission notice appear in all copies.",
        ],
    ],
    "Zlib": [
        [
            "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it "
            "freely, subject to the following restrictions:",
            "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a "
            "product, an acknowledgment in the product documentation would be appreciated but is not required.",
            "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
            "This notice may not be removed or altered from any source distribution.",
        ],
    ],
    "Apache-2.0": [
        [
            'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
            "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
            "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
            "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions "
            "and limitations under the License.",
        ],
        [
            "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, "
            "royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and "
            "distribute the Work and such Derivative Works in Source or Object form.",
        ],
    ],
    "GPL-2.0": [[_GNU.format(it="This program", name="General Public License", v="2")]],
    "GPL-3.0": [[_GNU.format(it="This program", name="General Public License", v="3")]],
    "LGPL-2.1": [[_GNU.format(it="This library", name="Lesser General Public License", v="2.1")]],
    "LGPL-3.0": [[_GNU.format(it="This library", name="Lesser General Public License", v="3")]],
    "AGPL-3.0": [[_GNU.format(it="This program", name="Affero General Public License", v="3")]],
    "MPL-2.0": [
        [
            "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
            "You can obtain one at https://mozilla.org/MPL/2.0/.",
        ],
    ],
    "MPL-1.1": [
        [
            'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in '
            "compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/",
        ],
    ],
    "Unlicense": [
        ["This is free and unencumbered software released into the public domain"],
        [
            "This is free and unencumbered software released into the public domain.",
            "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
            "for any purpose, commercial or non-commercial, and by any means.",
        ],
    ],
    "BSL-1.0": [
        [
            "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation "
            'covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative '
            "works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
        ],
    ],
    "CC0-1.0": [
        [
            "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        ],
        [
            "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public "
            "domain worldwide. This software is distributed without any warranty.",
        ],
    ],
    "WTFPL": [
        [
            "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the "
            "name is changed.",
            "You just DO WHAT THE FUCK YOU WANT TO.",
        ],
    ],
    "EPL-2.0": [
        [
            "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
            "https://www.eclipse.org/legal/epl-2.0/",
        ],
    ],
    "EPL-1.0": [
        [
            "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which "
            "accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
        ],
    ],
    "EUPL-1.2": [
        [
            "Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL "
            '(the "Licence"); You may not use this work except in compliance with the Licence.',
        ],
    ],
    "Artistic-2.0": [
        [
            "This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed. The "
            "intent is that the Copyright Holder maintains some artistic control over the development of that Package while still keeping the Package "
            "available as open source and free software.",
        ],
    ],
    "OFL-1.1": [
        [
            "This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is available with a FAQ at: "
            "https://scripts.sil.org/OFL",
        ],
    ],
}

DISCLAIMERS = [
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN "
    "THE SOFTWARE.",
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
]
