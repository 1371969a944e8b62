"""Signature rules for licence scans: label | priority | keywords | pattern.

Patterns meet lower-cased text; a rule is only tried on texts that hold its
keywords (joined by ``&``). A keyword has no separator in it and is part of every text that the
pattern matches, so that it never keeps a rule from a match. ``~`` stands for a run of characters that aren't letters or digits,
``^`` and ``$`` for the edges of a word. A higher priority wins where
detections lie in one another.
"""

from __future__ import annotations

#: Every text that a rule matches contains one of these, so a text without them has no detection.
STEMS = ("licen", "copyright", "domain", "spdx", "copyleft", "gnu.org", "opensource.org", "creativecommons.org", "commons", "warrant", "gpl", "redistribution", "permission", "perl", "cc")
#: Short stems that stand in many other words count only where this pattern matches too.
NARROW = {"cc": "^cc~by$", "perl": "^perl~itself$"}

#: 1: a mention of licensing; 2: a family; 3: a named licence; 4: its version; 5: an identifier or address.
RULES = r"""
apache-2.0 | 4 | apache & license | ^apache~license~(?:version~|v~?)?2(?:\.0)?$
apache-1.1 | 4 | apache | ^apache~(?:software~)?license~(?:version~|v~?)?1\.1$
apache-1.0 | 4 | apache | ^apache~(?:software~)?license~(?:version~|v~?)?1\.0$
apache | 3 | apache | ^apache~(?:software~)?license$
apache | 2 | apache | ^licensed~(?:to~the~)?apache$
apache-2.0 | 5 | licenses/license-2.0 | ^apache\.org/licenses/license-2\.0
apache-2.0 | 5 | licenses/apache-2.0 | opensource\.org/licenses/apache-2\.0
apache-2.0 | 5 | spdx | ^spdx-license-identifier:~apache-2\.0$
apache-2.0 | 3 | apache | ^licensed~under~the~apache~license~version~2\.0$
mit | 3 | mit & license | ^mit~license$
mit | 3 | licen & mit | ^licensed~under~(?:the~)?mit$
mit | 3 | licen & mit | ^mit~licensed$
mit | 3 | licen & expat | ^(?:the~)?expat~license$
mit | 4 | copyright & notice & permission | the~above~copyright~notice~and~this~permission~notice~shall~be~included
mit | 5 | licenses/mit | opensource\.org/licenses/mit
mit | 5 | spdx | ^spdx-license-identifier:~mit$
mit-0 | 4 | mit | ^mit~no~attribution~license$
mit-0 | 5 | spdx | ^spdx-license-identifier:~mit-0$
x11 | 3 | x11 | ^(?:mit~)?x11~license$
x11 | 5 | spdx | ^spdx-license-identifier:~x11$
gpl | 3 | general & public & license | ^general~public~license$
gpl | 2 | gpl | ^licensed~under~(?:the~)?(?:gnu~)?gpl$
gpl-1.0 | 4 | general & public & license | ^gnu~general~public~license~(?:version~|v~?)1(?:\.0)?$
gpl-2.0 | 4 | general & public & license | ^general~public~license~(?:version~|v~?)2(?:\.0)?$
gpl-3.0 | 4 | general & public & license | ^general~public~license~(?:version~|v~?)3(?:\.0)?$
gpl-2.0 | 4 | gpl | ^gpl~?v?~?2(?:\.0)?$
gpl-3.0 | 4 | gpl | ^gpl~?v?~?3(?:\.0)?$
gpl-2.0+ | 4 | general & public & license | ^general~public~license[^a-z]{0,4}~(?:either~)?version~2~(?:of~the~license~)?or~(?:at~your~option~)?any~later~version$
gpl-3.0+ | 4 | general & public & license | ^general~public~license[^a-z]{0,4}~(?:either~)?version~3~(?:of~the~license~)?or~(?:at~your~option~)?any~later~version$
gpl | 5 | gnu.org | ^gnu\.org/(?:licenses|copyleft)/gpl
gpl-2.0 | 5 | gnu.org | ^gnu\.org/licenses/(?:old-licenses/)?gpl-2
gpl-3.0 | 5 | gnu.org | ^gnu\.org/licenses/gpl-3
gpl-2.0 | 5 | licenses/gpl-2 | opensource\.org/licenses/gpl-2\.0
gpl-3.0 | 5 | licenses/gpl-3 | opensource\.org/licenses/gpl-3\.0
gpl-2.0 | 5 | spdx | ^spdx-license-identifier:~gpl-2\.0(?:-only)?$
gpl-3.0 | 5 | spdx | ^spdx-license-identifier:~gpl-3\.0(?:-only)?$
gpl-2.0+ | 5 | spdx | ^spdx-license-identifier:~gpl-2\.0(?:\+|-or-later$)
gpl-3.0+ | 5 | spdx | ^spdx-license-identifier:~gpl-3\.0(?:\+|-or-later$)
lgpl | 4 | lesser & general & public | ^lesser~general~public~license$
lgpl | 4 | library & general & public | ^library~general~public~license$
lgpl-2.1 | 5 | lesser & general & public | ^lesser~general~public~license~(?:version~|v~?)2\.1$
lgpl-3.0 | 5 | lesser & general & public | ^lesser~general~public~license~(?:version~|v~?)3(?:\.0)?$
lgpl-2.0 | 5 | library & general & public | ^library~general~public~license~(?:version~|v~?)2(?:\.0)?$
lgpl-2.1 | 4 | lgpl | ^lgpl~?v?~?2\.1$
lgpl-3.0 | 4 | lgpl | ^lgpl~?v?~?3(?:\.0)?$
lgpl | 5 | gnu.org | ^gnu\.org/(?:licenses|copyleft)/lgpl
lgpl-2.1 | 5 | spdx | ^spdx-license-identifier:~lgpl-2\.1
lgpl-3.0 | 5 | spdx | ^spdx-license-identifier:~lgpl-3\.0
agpl | 4 | affero & general & public | ^affero~general~public~license$
agpl-3.0 | 5 | affero & general & public | ^affero~general~public~license~(?:version~|v~?)3(?:\.0)?$
agpl-1.0 | 5 | affero & general & public | ^affero~general~public~license~(?:version~|v~?)1(?:\.0)?$
agpl-3.0 | 4 | agpl | ^agpl~?v?~?3(?:\.0)?$
agpl | 5 | gnu.org | ^gnu\.org/licenses/agpl
agpl-3.0 | 5 | spdx | ^spdx-license-identifier:~agpl-3\.0
gfdl | 3 | free & documentation & license | ^free~documentation~license$
gfdl-1.1 | 4 | free & documentation & license | ^free~documentation~license~(?:version~|v~?)1\.1$
gfdl-1.2 | 4 | free & documentation & license | ^free~documentation~license~(?:version~|v~?)1\.2$
gfdl-1.3 | 4 | free & documentation & license | ^free~documentation~license~(?:version~|v~?)1\.3$
gfdl | 5 | gnu.org | ^gnu\.org/(?:licenses|copyleft)/fdl
gfdl-1.3 | 5 | spdx | ^spdx-license-identifier:~gfdl-1\.3
bsd | 3 | licen & bsd | ^bsd~(?:style~)?licen[sc]e$
bsd | 3 | licen & bsd | ^licensed~under~(?:the~|a~)?bsd$
bsd | 3 | licen & berkeley | ^berkeley~software~distribution~license$
bsd-2-clause | 4 | licen & bsd | ^(?:bsd~2~clause|2~clause~bsd|two~clause~bsd|simplified~bsd|freebsd)~licen[sc]e$
bsd-3-clause | 4 | licen & bsd | ^(?:bsd~3~clause|3~clause~bsd|three~clause~bsd|new~bsd|modified~bsd|revised~bsd)~licen[sc]e$
bsd-4-clause | 4 | licen & bsd | ^(?:bsd~4~clause|4~clause~bsd|four~clause~bsd|original~bsd|old~bsd)~licen[sc]e$
bsd | 3 | redistribution | ^redistribution~and~use~in~source~and~binary~forms$
bsd-3-clause | 4 | endorse & promote & permission | used~to~endorse~or~promote~products~derived~from~this~software~without~specific~prior~written~permission
bsd-2-clause | 5 | spdx | ^spdx-license-identifier:~bsd-2-clause$
bsd-3-clause | 5 | spdx | ^spdx-license-identifier:~bsd-3-clause$
bsd-4-clause | 5 | spdx | ^spdx-license-identifier:~bsd-4-clause$
bsd-3-clause | 5 | licenses/bsd-3 | opensource\.org/licenses/bsd-3-clause
bsd-2-clause | 5 | licenses/bsd-2 | opensource\.org/licenses/bsd-2-clause
bsd-0-clause | 4 | licen & bsd | ^zero~clause~bsd~licen[sc]e$
bsd-0-clause | 5 | spdx | ^spdx-license-identifier:~0bsd$
isc | 3 | isc & license | ^isc~license$
isc | 3 | licen & isc | ^licensed~under~(?:the~)?isc$
isc | 5 | licenses/isc | opensource\.org/licenses/isc
isc | 5 | spdx | ^spdx-license-identifier:~isc$
mpl | 3 | mozilla & public & licen | ^mozilla~public~licen[sc]e$
mpl-1.0 | 4 | mozilla & public & licen | ^mozilla~public~licen[sc]e~(?:version~|v~?)?1\.0$
mpl-1.1 | 4 | mozilla & public & licen | ^mozilla~public~licen[sc]e~(?:version~|v~?)?1\.1$
mpl-2.0 | 4 | mozilla & public & licen | ^mozilla~public~licen[sc]e~(?:version~|v~?)?2\.0$
mpl-2.0 | 5 | spdx | ^spdx-license-identifier:~mpl-2\.0
mpl-1.1 | 5 | spdx | ^spdx-license-identifier:~mpl-1\.1$
mpl-2.0 | 5 | licenses/mpl-2 | opensource\.org/licenses/mpl-2\.0
npl | 3 | netscape & public & licen | ^netscape~public~licen[sc]e$
epl | 3 | eclipse & public & licen | ^eclipse~public~licen[sc]e$
epl-1.0 | 4 | eclipse & public & licen | ^eclipse~public~licen[sc]e~(?:version~|v~?)?1\.0$
epl-2.0 | 4 | eclipse & public & licen | ^eclipse~public~licen[sc]e~(?:version~|v~?)?2\.0$
epl-1.0 | 5 | spdx | ^spdx-license-identifier:~epl-1\.0$
epl-2.0 | 5 | spdx | ^spdx-license-identifier:~epl-2\.0$
cpl-1.0 | 3 | common & public & licen | ^common~public~licen[sc]e$
cpl-1.0 | 5 | spdx | ^spdx-license-identifier:~cpl-1\.0$
ipl-1.0 | 3 | ibm & public & licen | ^ibm~public~licen[sc]e$
ipl-1.0 | 5 | spdx | ^spdx-license-identifier:~ipl-1\.0$
cddl | 3 | common & development & distribution & licen | ^common~development~and~distribution~licen[sc]e$
cddl-1.0 | 4 | common & development & distribution & licen | ^common~development~and~distribution~licen[sc]e~(?:version~|v~?)?1\.0$
cddl-1.1 | 4 | common & development & distribution & licen | ^common~development~and~distribution~licen[sc]e~(?:version~|v~?)?1\.1$
cddl-1.0 | 5 | spdx | ^spdx-license-identifier:~cddl-1\.0$
eupl | 3 | european & union & public & licen | ^european~union~public~licen[sc]e$
eupl-1.1 | 4 | european & union & public & licen | ^european~union~public~licen[sc]e~(?:version~|v~?)?1\.1$
eupl-1.2 | 4 | european & union & public & licen | ^european~union~public~licen[sc]e~(?:version~|v~?)?1\.2$
eupl-1.2 | 5 | spdx | ^spdx-license-identifier:~eupl-1\.2$
cecill | 3 | cecill | ^cecill~(?:free~software~)?licen[sc]e
cecill-2.1 | 5 | spdx | ^spdx-license-identifier:~cecill-2\.1$
cecill-b | 5 | spdx | ^spdx-license-identifier:~cecill-b$
artistic | 3 | artistic & licen | ^artistic~licen[sc]e$
artistic-1.0 | 4 | artistic & licen | ^artistic~licen[sc]e~(?:version~|v~?)?1\.0$
artistic-2.0 | 4 | artistic & licen | ^artistic~licen[sc]e~(?:version~|v~?)?2\.0$
artistic-2.0 | 5 | spdx | ^spdx-license-identifier:~artistic-2\.0$
bsl-1.0 | 3 | boost & software & licen | ^boost~software~licen[sc]e$
bsl-1.0 | 5 | spdx | ^spdx-license-identifier:~bsl-1\.0$
busl-1.1 | 3 | business & source & licen | ^business~source~licen[sc]e$
busl-1.1 | 5 | spdx | ^spdx-license-identifier:~busl-1\.1$
sspl-1.0 | 3 | server & side & public & licen | ^server~side~public~licen[sc]e$
sspl-1.0 | 5 | spdx | ^spdx-license-identifier:~sspl-1\.0$
elastic-2.0 | 3 | elastic & licen | ^elastic~licen[sc]e$
elastic-2.0 | 5 | spdx | ^spdx-license-identifier:~elastic-2\.0$
unlicense | 3 | unlicense | ^(?:the~)?unlicense$
unlicense | 4 | public & domain | ^free~and~unencumbered~software~released~into~the~public~domain$
unlicense | 5 | spdx | ^spdx-license-identifier:~unlicense$
wtfpl | 4 | public & licen | ^do~what~the~f\S{1,4}~you~want~to~public~license$
wtfpl | 5 | spdx | ^spdx-license-identifier:~wtfpl$
zlib | 3 | zlib | ^zlib~(?:libpng~)?licen[sc]e$
zlib | 5 | spdx | ^spdx-license-identifier:~zlib$
libpng | 3 | libpng | ^libpng~licen[sc]e$
libpng | 5 | spdx | ^spdx-license-identifier:~libpng
openssl | 3 | openssl | ^openssl~licen[sc]e$
openssl | 5 | spdx | ^spdx-license-identifier:~openssl$
ssleay | 3 | ssleay | ^(?:original~)?ssleay~licen[sc]e$
curl | 5 | spdx | ^spdx-license-identifier:~curl$
python-2.0 | 3 | python & software & foundation & licen | ^python~software~foundation~licen[sc]e$
python-2.0 | 3 | psf & licen | ^psf~licen[sc]e$
python-2.0 | 5 | spdx | ^spdx-license-identifier:~(?:python|psf)-2\.0$
php-3.01 | 3 | php & licen | ^php~licen[sc]e$
php-3.01 | 5 | spdx | ^spdx-license-identifier:~php-3\.01$
ruby | 3 | ruby & licen | ^ruby~licen[sc]e$
ruby | 5 | spdx | ^spdx-license-identifier:~ruby$
perl | 4 | perl & itself | ^under~the~same~terms~as~perl~itself$
w3c | 3 | w3c & software | ^w3c~software~(?:notice~and~)?licen[sc]e$
w3c | 5 | spdx | ^spdx-license-identifier:~w3c$
ofl-1.1 | 3 | open & font & licen | ^open~font~licen[sc]e$
ofl-1.1 | 4 | open & font & licen | ^sil~open~font~licen[sc]e~(?:version~|v~?)?1\.1$
ofl-1.1 | 5 | spdx | ^spdx-license-identifier:~ofl-1\.1$
odbl-1.0 | 3 | open & database & licen | ^open~database~licen[sc]e$
odbl-1.0 | 5 | spdx | ^spdx-license-identifier:~odbl-1\.0$
odc-by-1.0 | 3 | open & data & commons | ^open~data~commons~attribution~licen[sc]e$
pddl-1.0 | 3 | public & domain & dedication | ^public~domain~dedication~and~licen[sc]e$
pddl-1.0 | 5 | spdx | ^spdx-license-identifier:~pddl-1\.0$
cdla-permissive | 3 | community & data & licen | ^community~data~licen[sc]e~agreement~permissive$
cdla-sharing | 3 | community & data & licen | ^community~data~licen[sc]e~agreement~sharing$
open-government | 3 | open & government & licen | ^open~government~licen[sc]e$
cc0-1.0 | 4 | creative & commons & zero | ^creative~commons~zero$
cc0-1.0 | 3 | licen & cc0 | ^cc0~(?:1\.0~)?(?:universal~)?licen[sc]e$
cc0-1.0 | 3 | licen & cc0 | ^licensed~under~(?:the~)?cc0$
cc0-1.0 | 5 | creativecommons.org | ^creativecommons\.org/publicdomain/zero/1\.0
cc0-1.0 | 5 | spdx | ^spdx-license-identifier:~cc0-1\.0$
cc-pdm | 5 | creativecommons.org | ^creativecommons\.org/publicdomain/mark/1\.0
cc | 2 | creative & commons | ^creative~commons~licen[sc]e$
cc-by | 3 | creative & commons & attribution | ^creative~commons~attribution$
cc-by-sa | 4 | creative & commons & attribution | ^creative~commons~attribution~share~?alike$
cc-by-nc | 4 | creative & commons & attribution | ^creative~commons~attribution~non~?commercial$
cc-by-nd | 4 | creative & commons & attribution | ^creative~commons~attribution~no~?deriv(?:ative)?s?(?:~works)?$
cc-by-nc-sa | 5 | creative & commons & attribution | ^creative~commons~attribution~non~?commercial~share~?alike$
cc-by-nc-nd | 5 | creative & commons & attribution | ^creative~commons~attribution~non~?commercial~no~?deriv(?:ative)?s?(?:~works)?$
cc-by | 3 | licen & cc | ^licensed~under~(?:the~|a~)?cc~by$
cc-by-sa | 4 | licen & cc | ^licensed~under~(?:the~|a~)?cc~by~sa$
cc-by-nc | 4 | licen & cc | ^licensed~under~(?:the~|a~)?cc~by~nc$
cc-by-nd | 4 | licen & cc | ^licensed~under~(?:the~|a~)?cc~by~nd$
cc-by-nc-sa | 5 | licen & cc | ^licensed~under~(?:the~|a~)?cc~by~nc~sa$
cc-by-nc-nd | 5 | licen & cc | ^licensed~under~(?:the~|a~)?cc~by~nc~nd$
cc-by-2.0 | 5 | cc & by & 2.0 | ^cc~by~2\.0$
cc-by-3.0 | 5 | cc & by & 3.0 | ^cc~by~3\.0$
cc-by-4.0 | 5 | cc & by & 4.0 | ^cc~by~4\.0$
cc-by-sa-3.0 | 5 | cc & by & 3.0 | ^cc~by~sa~3\.0$
cc-by-sa-4.0 | 5 | cc & by & 4.0 | ^cc~by~sa~4\.0$
cc-by-nc-3.0 | 5 | cc & by & 3.0 | ^cc~by~nc~3\.0$
cc-by-nc-4.0 | 5 | cc & by & 4.0 | ^cc~by~nc~4\.0$
cc-by-nd-4.0 | 5 | cc & by & 4.0 | ^cc~by~nd~4\.0$
cc-by-nc-sa-4.0 | 5 | cc & by & 4.0 | ^cc~by~nc~sa~4\.0$
cc-by-nc-nd-4.0 | 5 | cc & by & 4.0 | ^cc~by~nc~nd~4\.0$
cc-by | 4 | creativecommons.org | ^creativecommons\.org/licenses/by/
cc-by-sa | 4 | creativecommons.org | ^creativecommons\.org/licenses/by-sa/
cc-by-nc | 4 | creativecommons.org | ^creativecommons\.org/licenses/by-nc/
cc-by-nd | 4 | creativecommons.org | ^creativecommons\.org/licenses/by-nd/
cc-by-nc-sa | 4 | creativecommons.org | ^creativecommons\.org/licenses/by-nc-sa/
cc-by-nc-nd | 4 | creativecommons.org | ^creativecommons\.org/licenses/by-nc-nd/
cc-by-3.0 | 5 | creativecommons.org | ^creativecommons\.org/licenses/by/3\.0
cc-by-4.0 | 5 | creativecommons.org | ^creativecommons\.org/licenses/by/4\.0
cc-by-sa-3.0 | 5 | creativecommons.org | ^creativecommons\.org/licenses/by-sa/3\.0
cc-by-sa-4.0 | 5 | creativecommons.org | ^creativecommons\.org/licenses/by-sa/4\.0
cc-by-nc-4.0 | 5 | creativecommons.org | ^creativecommons\.org/licenses/by-nc/4\.0
cc-by-4.0 | 5 | spdx | ^spdx-license-identifier:~cc-by-4\.0$
cc-by-sa-4.0 | 5 | spdx | ^spdx-license-identifier:~cc-by-sa-4\.0$
cc-by-nc-4.0 | 5 | spdx | ^spdx-license-identifier:~cc-by-nc-4\.0$
ms-pl | 3 | microsoft & public & licen | ^microsoft~public~licen[sc]e$
ms-pl | 5 | spdx | ^spdx-license-identifier:~ms-pl$
ms-rl | 3 | microsoft & reciprocal & licen | ^microsoft~reciprocal~licen[sc]e$
ms-rl | 5 | spdx | ^spdx-license-identifier:~ms-rl$
afl-3.0 | 3 | academic & free & licen | ^academic~free~licen[sc]e$
afl-3.0 | 5 | spdx | ^spdx-license-identifier:~afl-3\.0$
osl-3.0 | 3 | open & software & licen | ^open~software~licen[sc]e$
osl-3.0 | 5 | spdx | ^spdx-license-identifier:~osl-3\.0$
apsl-2.0 | 3 | apple & public & source & licen | ^apple~public~source~licen[sc]e$
apsl-2.0 | 5 | spdx | ^spdx-license-identifier:~apsl-2\.0$
qpl-1.0 | 3 | public & licen | ^q~public~licen[sc]e$
sleepycat | 3 | sleepycat & licen | ^sleepycat~licen[sc]e$
vim | 3 | vim & licen | ^vim~licen[sc]e$
beerware | 4 | beer-ware & licen | ^beer-ware~licen[sc]e$
ncsa | 3 | illinois | ^university~of~illinois(?:~ncsa)?~open~source~licen[sc]e$
ncsa | 5 | spdx | ^spdx-license-identifier:~ncsa$
postgresql | 3 | postgresql & licen | ^postgresql~licen[sc]e$
postgresql | 5 | spdx | ^spdx-license-identifier:~postgresql$
upl-1.0 | 3 | universal & permissive & licen | ^universal~permissive~licen[sc]e$
upl-1.0 | 5 | spdx | ^spdx-license-identifier:~upl-1\.0$
unicode | 3 | unicode & licen | ^unicode~licen[sc]e$
hpnd | 4 | permission & distribute & documentation | ^permission~to~use~copy~modify~and~distribute~this~software~and~its~documentation~for~any~purpose$
polyform | 3 | polyform | ^polyform~(?:noncommercial|shield|strict|small~business|perimeter|free~trial)~licen[sc]e$
openrail | 3 | open & rail & licen | ^(?:creativeml~|bigscience~)?open~?rail~(?:m~)?licen[sc]e$
llama | 3 | community & licen | ^llama~(?:[0-9](?:\.[0-9])?~)?community~licen[sc]e$
proprietary | 2 | copyright | ^copyright~(?:c~)?[^\n]{0,80}~all~rights~reserved$
proprietary | 2 | proprietary | ^proprietary~(?:and~confidential~)?licen[sc]e$
proprietary | 2 | licen & agreement | ^end~user~licen[sc]e~agreement$
public-domain | 2 | public & domain | ^(?:released~into|placed~in|dedicated~to|in)~the~public~domain$
copyleft | 2 | copyleft | ^copyleft$
spdx-other | 1 | spdx | ^spdx-license-identifier:~[a-z0-9][a-z0-9.+-]*
warranty-disclaimer | 1 | warrant | ^without~warrant(?:y|ies)~(?:or~conditions~)?of~any~kind$
unknown-license | 1 | licensed | ^(?:re)?licensed~under~(?:the~)?(?:terms~of~)?[^\n]{0,60}
unknown-license | 1 | licen & released | ^released~under~(?:the~)?(?:terms~of~)?[a-z0-9]+~licen[sc]e$
unknown-license | 1 | licen & see | ^see~(?:the~)?licen[sc]e~(?:file~)?for~(?:more~)?(?:details|information)$
"""
