"""Public licence texts and notices, in passages, by family.

A family's passages are in no order; each is a stretch that its texts or
notices have.  OTHER holds passages of further licences: the unknown class
learns from some of these and is calibrated on the rest.
"""

from __future__ import annotations

TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache-2.0": (
        "licensed under the apache license version 2.0",
        "released under the apache 2.0 license",
        "this project uses the apache software license 2.0",
        "spdx license identifier apache 2.0",
        "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license",
        "you may obtain a copy of the license at http www apache org licenses license 2.0",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
        "see the license for the specific language governing permissions and limitations under the license",
        "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of",
        "licensed to the apache software foundation asf under one or more contributor license agreements",
    ),
    "mit": (
        "released under the mit license",
        "licensed under the mit license",
        "the mit license mit copyright",
        "spdx license identifier mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        "use of this source code is governed by an mit style license",
    ),
    "isc": (
        "released under the isc license",
        "licensed under the isc license",
        "spdx license identifier isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
        "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits",
    ),
    "bsd": (
        "released under the bsd 3 clause license",
        "licensed under the bsd 2 clause license",
        "spdx license identifier bsd 3 clause",
        "use of this source code is governed by a bsd style license that can be found in the license file",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties are disclaimed",
    ),
    "gpl": (
        "or at your option any later version of the gnu general public license",
        "this work is licensed under the gnu general public license version 3",
        "released under the gnu general public license version 2 or later",
        "along with this program you should have a copy of the gnu general public license",
        "this is free software under the terms of the gnu gpl",
        "licensed under the gpl v3",
        "spdx license identifier gpl 3.0 or later",
        "under the terms of the gnu general public license as published by the",
        "see the gnu general public license for more details",
        "the gnu general public license is a free copyleft license for software",
        "free software you can redistribute it and or modify it under the terms",
        "you should have received a copy of the gnu general public license along",
    ),
    "lgpl": (
        "licensed under the gnu lesser general public license version 2.1",
        "released under the lgpl v3",
        "spdx license identifier lgpl 2.1",
        "see the gnu lesser general public license for more details",
        "under the terms of the gnu lesser general public license as published",
        "you should have received a copy of the gnu lesser general public license",
        "gnu library general public license for more details",
    ),
    "agpl": (
        "licensed under the gnu affero general public license version 3",
        "released under the agpl v3",
        "spdx license identifier agpl 3.0",
        "under the terms of the gnu affero general public license as published",
        "see the gnu affero general public license for more details",
        "you should have received a copy of the gnu affero general public license",
    ),
    "mpl-2.0": (
        "this source code form is subject to the terms of the mozilla public license v 2.0",
        "licensed under the mozilla public license version 2.0",
        "released under the mpl 2.0",
        "spdx license identifier mpl 2.0",
        "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2.0",
        "this source code form is incompatible with secondary licenses as defined by the mozilla public license",
    ),
    "cc-by": (
        "licensed under cc by 4.0",
        "this work is licensed under a creative commons attribution 4.0 international license",
        "released under the creative commons attribution license",
        "to view a copy of this license visit http creativecommons org licenses by 4.0",
        "distributed under the terms of the creative commons attribution license which permits unrestricted use distribution and reproduction in any medium provided the original work is properly cited",
    ),
    "cc-by-sa": (
        "licensed under cc by sa 4.0",
        "licensed under cc by sa 3.0",
        "licensed under a creative commons attribution sharealike 4.0 international license",
        "text is available under the creative commons attribution sharealike license additional terms may apply",
        "to view a copy of this license visit http creativecommons org licenses by sa 4.0",
    ),
    "cc-by-nc": (
        "licensed under cc by nc 4.0",
        "licensed under a creative commons attribution noncommercial 4.0 international license",
        "licensed under cc by nc sa 4.0",
        "licensed under a creative commons attribution noncommercial sharealike 4.0 international license",
        "to view a copy of this license visit http creativecommons org licenses by nc 4.0",
    ),
    "cc-by-nd": (
        "licensed under cc by nd 4.0",
        "licensed under a creative commons attribution noderivatives 4.0 international license",
        "to view a copy of this license visit http creativecommons org licenses by nd 4.0",
    ),
    "public-domain": (
        "this work is dedicated to the public domain",
        "released under cc0 1.0 universal",
        "this is free and unencumbered software released into the public domain",
        "released under the unlicense",
        "the unlicense",
        "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        "the author or authors of this software dedicate any and all copyright interest in the software to the public domain",
        "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
        "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law",
    ),
    "zlib": (
        "released under the zlib license",
        "spdx license identifier zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
        "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
        "altered source versions must be plainly marked as such and must not be misrepresented as being the original software",
    ),
    "proprietary": (
        "all rights reserved",
        "no part may be reproduced without written permission",
        "no part of this publication may be reproduced distributed or transmitted in any form or by any means without the prior written permission of the publisher",
        "this software is confidential and proprietary information you shall not disclose such confidential information",
        "unauthorized copying of this file via any medium is strictly prohibited proprietary and confidential",
    ),
}
#: Licences without a family here.
OTHER: dict[str, tuple[str, ...]] = {
    "epl": (
        "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0",
        "licensed under the eclipse public license version 1.0",
        "the accompanying program is provided under the terms of this eclipse public license any use reproduction or distribution of the program constitutes acceptance of this agreement",
        "spdx license identifier epl 2.0",
    ),
    "boost": (
        "distributed under the boost software license version 1.0",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
        "spdx license identifier bsl 1.0",
    ),
    "artistic": (
        "licensed under the artistic license 2.0",
        "this program is free software you can redistribute it and or modify it under the same terms as perl itself",
        "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed the intent of this document is to state the conditions under which a package may be copied",
    ),
    "ofl": (
        "this font software is licensed under the sil open font license version 1.1",
        "the fonts including any derivative works can be bundled embedded redistributed and or sold with any software provided that any reserved names are not used by derivative works",
    ),
    "cddl": (
        "the contents of this file are subject to the terms of the common development and distribution license",
        "you can obtain a copy of the license at usr src opensolaris license or http www opensolaris org os licensing",
        "licensed under the cddl 1.0",
    ),
    "wtfpl": ("do what the fuck you want to public license", "licensed under the wtfpl version 2"),
    "ms": ("this source code is subject to terms and conditions of the microsoft public license", "licensed under the microsoft reciprocal license ms rl"),
    "eupl": (
        "licensed under the eupl version 1.2 or as soon they will be approved by the european commission subsequent versions of the eupl",
        "you may not use this work except in compliance with the licence you may obtain a copy of the licence at joinup ec europa eu software page eupl",
    ),
    "python": ("licensed under the python software foundation license version 2", "psf is making python available to licensee on an as is basis psf makes no representations or warranties express or implied"),
    "php": ("this source file is subject to version 3.01 of the php license that is bundled with this package in the file license",),
    "cecill": ("this software is governed by the cecill license under french law and abiding by the rules of distribution of free software",),
    "afl": ("licensed under the academic free license version 3.0", "licensor hereby grants you a worldwide royalty free non exclusive license for the duration of the copyright"),
    "odbl": ("this database is made available under the open database license whose full text can be found at opendatacommons org licenses odbl", "made available under the open government licence v3.0"),
    "ncsa": ("developed by the university under the university of illinois ncsa open source license",),
}
#: Of OTHER, those that no weight is fitted on.
HELD_OUT = frozenset({"eupl", "php", "cecill", "afl", "ms", "odbl"})
#: Lines that speak of licences and grant none.
LOOKALIKES = (
    "the driver lost his license after the accident",
    "license fees must be paid at the town hall each year",
    "the version of the story that was released under pressure",
    "the general public is invited to the work under the bridge",
    "a copy of the letter was obtained free of charge by this person",
    "permission to enter was granted to the public",
    "the creative commons of the village is a public place",
    "they are reserved and all rights are with the source",
    "he works at mit and she is licensed to practice",
    "apache helicopters were released under a new version of the plan",
    "no license is given here",
    "see the license file",
    "she is a licensed physician and the permit is issued under the public health act",
    "the software was released in version 2.0 without a license",
)
