"""License scans by ordered signature rules (DataFrame operations only).

Rules are hand-written regular expressions, each with the keywords of which a
text must hold one for the rule to be tried (in lower case, with a blank for
white space and hyphens), and a priority: SPDX tags, then titles with a version,
then titles, links, and passing mentions.  The gate before all rules is made of
their keywords, put together letter by letter, so one pass over a text tells
whether any rule can match.  Where detections overlap, one
that lies within another is dropped unless its priority is higher; of equal
intervals the higher priority stays, then the earlier rule.  Base phrases are found
apart from the rules, by whole words, and their labels always stay.

Cases: null is the empty text; texts without a keyword are not tried; repeated
rows are scanned alike; overlapping and repeated mentions count as places of
their own; letters are folded A-Z only for words, and ASCII-only in rules.
"""

from __future__ import annotations

import json
import re
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepgauge.llm.sketch import let

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BASE = (
    (("gnu", "general", "public", "license"), "gpl"),
    (("apache", "license"), "apache"),
    (("cc", "by"), "cc-by"),
    (("mit", "license"), "mit"),
)

_V = r"(?:,?\s*(?:\(?the\s+\"?license\"?\)?\s*)?,?\s*(?:version|ver\.?|v\.?)?\s*)"
_LATER = r"(?:\s*(?:\+|or[ -](?:\(at your option\)\s*)?(?:any\s+)?later(?:\s+version)?))"
_ONLY = r"(?![\d.]*\d)"

#: label, keywords, expression; SPDX tags of these are rules of their own.  In order: the first of equal detections stays.
TITLES: list[tuple[str, str, str]] = [
    # the GNU family
    ("gpl-1.0", "general public", rf"gnu\s+general\s+public\s+licen[sc]e{_V}1(?:\.0)?{_ONLY}"),
    ("gpl-2.0-or-later", "general public", rf"gnu\s+general\s+public\s+licen[sc]e{_V}2(?:\.0)?{_LATER}"),
    ("gpl-2.0", "general public", rf"gnu\s+general\s+public\s+licen[sc]e{_V}2(?:\.0)?{_ONLY}"),
    ("gpl-3.0-or-later", "general public", rf"gnu\s+general\s+public\s+licen[sc]e{_V}3(?:\.0)?{_LATER}"),
    ("gpl-3.0", "general public", rf"gnu\s+general\s+public\s+licen[sc]e{_V}3(?:\.0)?{_ONLY}"),
    ("lgpl-2.0", "general public", rf"gnu\s+library\s+general\s+public\s+licen[sc]e{_V}2(?:\.0)?{_ONLY}"),
    ("lgpl-2.1-or-later", "lesser general", rf"gnu\s+lesser\s+general\s+public\s+licen[sc]e{_V}2\.1{_LATER}"),
    ("lgpl-2.1", "lesser general", rf"gnu\s+lesser\s+general\s+public\s+licen[sc]e{_V}2\.1"),
    ("lgpl-3.0-or-later", "lesser general", rf"gnu\s+lesser\s+general\s+public\s+licen[sc]e{_V}3(?:\.0)?{_LATER}"),
    ("lgpl-3.0", "lesser general", rf"gnu\s+lesser\s+general\s+public\s+licen[sc]e{_V}3(?:\.0)?{_ONLY}"),
    ("agpl-3.0-or-later", "affero", rf"gnu\s+affero\s+general\s+public\s+licen[sc]e{_V}3(?:\.0)?{_LATER}"),
    ("agpl-3.0", "affero", rf"(?:gnu\s+)?affero\s+general\s+public\s+licen[sc]e{_V}3(?:\.0)?{_ONLY}"),
    ("agpl-1.0", "affero", rf"affero\s+general\s+public\s+licen[sc]e{_V}1(?:\.0)?{_ONLY}"),
    ("gfdl-1.1", "free documentation", rf"gnu\s+free\s+documentation\s+licen[sc]e{_V}1\.1"),
    ("gfdl-1.2", "free documentation", rf"gnu\s+free\s+documentation\s+licen[sc]e{_V}1\.2"),
    ("gfdl-1.3", "free documentation", rf"gnu\s+free\s+documentation\s+licen[sc]e{_V}1\.3"),
    # Apache
    ("apache-1.0", "apache", rf"apache\s+(?:software\s+)?licen[sc]e{_V}1\.0"),
    ("apache-1.1", "apache", rf"apache\s+(?:software\s+)?licen[sc]e{_V}1\.1"),
    ("apache-2.0", "apache", rf"apache\s+(?:software\s+)?licen[sc]e{_V}2(?:\.0)?{_ONLY}"),
    # Creative Commons
    ("cc0-1.0", "cc0", r"\bcc0(?:[ -]1\.0)?\b(?:\s+universal)?"),
    ("cc-by-1.0", "cc by", r"\bcc[ -]by[ -]1\.0"),
    ("cc-by-2.0", "cc by", r"\bcc[ -]by[ -]2\.0"),
    ("cc-by-2.5", "cc by", r"\bcc[ -]by[ -]2\.5"),
    ("cc-by-3.0", "cc by", r"\bcc[ -]by[ -]3(?:\.0)?\b"),
    ("cc-by-4.0", "cc by", r"\bcc[ -]by[ -]4(?:\.0)?\b"),
    ("cc-by-sa-1.0", "cc by", r"\bcc[ -]by[ -]sa[ -]1\.0"),
    ("cc-by-sa-2.0", "cc by", r"\bcc[ -]by[ -]sa[ -]2\.0"),
    ("cc-by-sa-2.5", "cc by", r"\bcc[ -]by[ -]sa[ -]2\.5"),
    ("cc-by-sa-3.0", "cc by", r"\bcc[ -]by[ -]sa[ -]3(?:\.0)?\b"),
    ("cc-by-sa-4.0", "cc by", r"\bcc[ -]by[ -]sa[ -]4(?:\.0)?\b"),
    ("cc-by-nd-2.0", "cc by", r"\bcc[ -]by[ -]nd[ -]2\.0"),
    ("cc-by-nd-3.0", "cc by", r"\bcc[ -]by[ -]nd[ -]3(?:\.0)?\b"),
    ("cc-by-nd-4.0", "cc by", r"\bcc[ -]by[ -]nd[ -]4(?:\.0)?\b"),
    ("cc-by-nc-2.0", "cc by", r"\bcc[ -]by[ -]nc[ -]2\.0"),
    ("cc-by-nc-3.0", "cc by", r"\bcc[ -]by[ -]nc[ -]3(?:\.0)?\b"),
    ("cc-by-nc-4.0", "cc by", r"\bcc[ -]by[ -]nc[ -]4(?:\.0)?\b"),
    ("cc-by-nc-sa-2.0", "cc by", r"\bcc[ -]by[ -]nc[ -]sa[ -]2\.0"),
    ("cc-by-nc-sa-3.0", "cc by", r"\bcc[ -]by[ -]nc[ -]sa[ -]3(?:\.0)?\b"),
    ("cc-by-nc-sa-4.0", "cc by", r"\bcc[ -]by[ -]nc[ -]sa[ -]4(?:\.0)?\b"),
    ("cc-by-nc-nd-3.0", "cc by", r"\bcc[ -]by[ -]nc[ -]nd[ -]3(?:\.0)?\b"),
    ("cc-by-nc-nd-4.0", "cc by", r"\bcc[ -]by[ -]nc[ -]nd[ -]4(?:\.0)?\b"),
    ("cc-by-4.0", "creative commons", rf"creative\s+commons\s+attribution{_V}4\.0"),
    ("cc-by-3.0", "creative commons", rf"creative\s+commons\s+attribution{_V}3\.0"),
    ("cc-by-sa-4.0", "creative commons", r"creative\s+commons\s+attribution[ -]share[ -]?alike\s+4\.0"),
    ("cc-by-sa-3.0", "creative commons", r"creative\s+commons\s+attribution[ -]share[ -]?alike\s+3\.0"),
    ("cc-by-nc-4.0", "creative commons", r"creative\s+commons\s+attribution[ -]non-?commercial\s+4\.0"),
    ("cc-by-nc-sa-4.0", "creative commons", r"creative\s+commons\s+attribution[ -]non-?commercial[ -]share[ -]?alike\s+4\.0"),
    ("cc-by-nd-4.0", "creative commons", r"creative\s+commons\s+attribution[ -]no[ -]?derivatives\s+4\.0"),
    ("cc-by-nc-nd-4.0", "creative commons", r"creative\s+commons\s+attribution[ -]non-?commercial[ -]no[ -]?derivatives\s+4\.0"),
    # BSD, MIT and their kin
    ("bsd-1-clause", "bsd", r"(?:bsd[ -]1[ -]clause|1[ -]clause\s+bsd)(?:\s+licen[sc]e)?"),
    ("bsd-2-clause", "bsd", r"(?:bsd[ -]2[ -]clause|(?:2|two)[ -]clause\s+bsd|simplified\s+bsd)(?:\s+licen[sc]e)?"),
    ("bsd-3-clause", "bsd", r"(?:bsd[ -]3[ -]clause|(?:3|three)[ -]clause\s+bsd|(?:new|modified|revised)\s+bsd)(?:\s+licen[sc]e)?"),
    ("bsd-4-clause", "bsd", r"(?:bsd[ -]4[ -]clause|(?:4|four)[ -]clause\s+bsd|original\s+bsd)(?:\s+licen[sc]e)?"),
    ("0bsd", "bsd", r"(?:\b0bsd\b|zero[ -]clause\s+bsd(?:\s+licen[sc]e)?)"),
    ("mit-0", "mit 0|mit no attribution", r"\bmit(?:[ -]0|\s+no\s+attribution)(?:\s+licen[sc]e)?"),
    ("x11", "x11 licen", r"\bx11\s+licen[sc]e"),
    ("isc", "isc licen", r"\bisc\s+licen[sc]e"),
    ("ncsa", "ncsa", r"(?:university\s+of\s+illinois[/ ]+)?ncsa\s+open\s+source\s+licen[sc]e"),
    ("zlib", "zlib licen|zlib/libpng|zlib libpng", r"\bzlib(?:[/ ]libpng)?\s+licen[sc]e"),
    ("libpng", "libpng licen", r"\blibpng\s+licen[sc]e"),
    ("bsl-1.0", "boost software", rf"boost\s+software\s+licen[sc]e(?:{_V}1\.0)?"),
    ("unlicense", "unlicense", r"\b(?:the\s+)?unlicense\b"),
    ("wtfpl", "wtfpl", r"\bwtfpl\b"),
    ("python-2.0", "python licen|python software", rf"python\s+(?:software\s+foundation\s+)?licen[sc]e(?:{_V}2(?:\.0)?)?"),
    ("postgresql", "postgresql", r"postgresql\s+licen[sc]e"),
    ("php-3.01", "php licen", rf"php\s+licen[sc]e{_V}3\.01"),
    ("php-3.0", "php licen", rf"php\s+licen[sc]e{_V}3\.0{_ONLY}"),
    ("ruby", "ruby licen", r"\bruby\s+licen[sc]e"),
    ("vim", "vim licen", r"\bvim\s+licen[sc]e"),
    ("curl", "curl licen", r"\bcurl\s+licen[sc]e"),
    ("openssl", "openssl licen", r"\bopenssl\s+licen[sc]e"),
    ("artistic-1.0", "artistic licen", rf"artistic\s+licen[sc]e{_V}1\.0"),
    ("artistic-2.0", "artistic licen", rf"artistic\s+licen[sc]e{_V}2(?:\.0)?{_ONLY}"),
    ("afl-2.1", "academic free", rf"academic\s+free\s+licen[sc]e{_V}2\.1"),
    ("afl-3.0", "academic free", rf"academic\s+free\s+licen[sc]e{_V}3\.0"),
    ("osl-2.1", "open software", rf"open\s+software\s+licen[sc]e{_V}2\.1"),
    ("osl-3.0", "open software", rf"open\s+software\s+licen[sc]e{_V}3\.0"),
    # weak copyleft and corporate ones
    ("mpl-1.0", "mozilla public", rf"mozilla\s+public\s+licen[sc]e{_V}1\.0"),
    ("mpl-1.1", "mozilla public", rf"mozilla\s+public\s+licen[sc]e{_V}1\.1"),
    ("mpl-2.0", "mozilla public", rf"mozilla\s+public\s+licen[sc]e{_V}2(?:\.0)?{_ONLY}"),
    ("epl-1.0", "eclipse public", rf"eclipse\s+public\s+licen[sc]e{_V}1(?:\.0)?{_ONLY}"),
    ("epl-2.0", "eclipse public", rf"eclipse\s+public\s+licen[sc]e{_V}2(?:\.0)?{_ONLY}"),
    ("cpl-1.0", "common public licen", rf"common\s+public\s+licen[sc]e(?:{_V}1\.0)?"),
    ("cddl-1.0", "common development", rf"common\s+development\s+and\s+distribution\s+licen[sc]e{_V}1\.0"),
    ("cddl-1.1", "common development", rf"common\s+development\s+and\s+distribution\s+licen[sc]e{_V}1\.1"),
    ("eupl-1.1", "european union public", rf"european\s+union\s+public\s+licen[sc]e{_V}1\.1"),
    ("eupl-1.2", "european union public", rf"european\s+union\s+public\s+licen[sc]e{_V}1\.2"),
    ("ms-pl", "microsoft public", r"microsoft\s+public\s+licen[sc]e"),
    ("ms-rl", "microsoft reciprocal", r"microsoft\s+reciprocal\s+licen[sc]e"),
    ("ipl-1.0", "ibm public", rf"ibm\s+public\s+licen[sc]e(?:{_V}1\.0)?"),
    ("apsl-2.0", "apple public", rf"apple\s+public\s+source\s+licen[sc]e(?:{_V}2\.0)?"),
    ("qpl-1.0", "public licen", r"\bq\s+public\s+licen[sc]e"),
    ("sissl", "sun industry", r"sun\s+industry\s+standards\s+source\s+licen[sc]e"),
    ("upl-1.0", "universal permissive", r"universal\s+permissive\s+licen[sc]e"),
    ("w3c", "w3c", r"w3c\s+software\s+(?:notice\s+and\s+)?licen[sc]e"),
    ("ofl-1.1", "open font", rf"(?:sil\s+)?open\s+font\s+licen[sc]e(?:{_V}1\.1)?"),
    ("odbl-1.0", "open database", r"open\s+(?:data\s+commons\s+open\s+)?database\s+licen[sc]e"),
    ("odc-by-1.0", "open data commons", r"open\s+data\s+commons\s+attribution\s+licen[sc]e"),
    ("pddl-1.0", "public domain", r"(?:open\s+data\s+commons\s+)?public\s+domain\s+dedication\s+(?:and|&)\s+licen[sc]e"),
    ("bsl-1.1", "business source", rf"business\s+source\s+licen[sc]e(?:{_V}1\.1)?"),
    ("sspl-1.0", "server side", r"server\s+side\s+public\s+licen[sc]e"),
    ("elastic-2.0", "elastic licen", rf"elastic\s+licen[sc]e(?:{_V}2\.0)?"),
    ("openrail-m", "openrail", r"\bopenrail(?:\+\+)?[ -]?m?\b"),
    ("blueoak-1.0.0", "blue oak", r"blue\s+oak\s+model\s+licen[sc]e"),
    ("cecill-2.1", "cecill", rf"cecill(?:\s+free\s+software\s+licen[sc]e(?:\s+agreement)?)?{_V}2\.1"),
    ("cecill-b", "cecill", r"\bcecill-b\b"),
    ("cecill-c", "cecill", r"\bcecill-c\b"),
    ("mulanpsl-2.0", "mulan", rf"mulan\s+permissive\s+software\s+licen[sc]e{_V}2"),
    ("lppl-1.3c", "latex project", rf"latex\s+project\s+public\s+licen[sc]e(?:{_V}1\.3c)?"),
    ("json", "json licen", r"\bjson\s+licen[sc]e\b"),
    ("beerware", "beerware", r"\bbeerware(?:\s+licen[sc]e)?\b"),
    # others of the open-source and data worlds
    ("aladdin", "aladdin free", r"aladdin\s+free\s+public\s+licen[sc]e"),
    ("apl-1.0", "adaptive public", r"adaptive\s+public\s+licen[sc]e"),
    ("cpal-1.0", "common public attribution", r"common\s+public\s+attribution\s+licen[sc]e"),
    ("cua-opl-1.0", "cua office", r"cua\s+office\s+public\s+licen[sc]e"),
    ("ecl-2.0", "educational community", rf"educational\s+community\s+licen[sc]e(?:{_V}2\.0)?"),
    ("efl-2.0", "eiffel forum", rf"eiffel\s+forum\s+licen[sc]e(?:{_V}2)?"),
    ("entessa", "entessa public", r"entessa\s+public\s+licen[sc]e"),
    ("fair", "fair licen", r"\bfair\s+licen[sc]e\b"),
    ("frameworx-1.0", "frameworx open", r"frameworx\s+open\s+licen[sc]e"),
    ("hpnd", "historical permission", r"historical\s+permission\s+notice\s+and\s+disclaimer"),
    ("ijg", "independent jpeg", r"independent\s+jpeg\s+group\s+licen[sc]e"),
    ("imagemagick", "imagemagick licen", r"\bimagemagick\s+licen[sc]e"),
    ("intel", "intel open source", r"\bintel\s+open\s+source\s+licen[sc]e"),
    ("lal-1.3", "free art licen|licence art libre", r"(?:free\s+art\s+licen[sc]e|licence\s+art\s+libre)"),
    ("lpl-1.02", "lucent public", rf"lucent\s+public\s+licen[sc]e(?:{_V}1\.02)?"),
    ("miros", "miros licen", r"\bmiros\s+licen[sc]e"),
    ("motosoto", "motosoto open", r"motosoto\s+open\s+source\s+licen[sc]e"),
    ("nasa-1.3", "nasa open source", r"\bnasa\s+open\s+source\s+agreement"),
    ("naumen", "naumen public", r"naumen\s+public\s+licen[sc]e"),
    ("ngpl", "nethack general", r"nethack\s+general\s+public\s+licen[sc]e"),
    ("nokia", "nokia open source", r"nokia\s+open\s+source\s+licen[sc]e"),
    ("npl-1.1", "netscape public", rf"netscape\s+public\s+licen[sc]e(?:{_V}1\.1)?"),
    ("oclc-2.0", "oclc research", r"oclc\s+research\s+public\s+licen[sc]e"),
    ("ogtsl", "open group test", r"open\s+group\s+test\s+suite\s+licen[sc]e"),
    ("opl-1.0", "open publication", r"open\s+publication\s+licen[sc]e"),
    ("oset-pl-2.1", "oset public", r"\boset\s+public\s+licen[sc]e"),
    ("ogl-uk-3.0", "open government", rf"open\s+government\s+licen[sc]e(?:{_V}3\.0)?"),
    ("rscpl", "ricoh source", r"ricoh\s+source\s+code\s+public\s+licen[sc]e"),
    ("rpsl-1.0", "realnetworks public", r"realnetworks\s+public\s+source\s+licen[sc]e"),
    ("rpl-1.5", "reciprocal public", rf"reciprocal\s+public\s+licen[sc]e(?:{_V}1\.5)?"),
    ("sleepycat", "sleepycat licen", r"\bsleepycat\s+licen[sc]e"),
    ("sgi-b-2.0", "sgi free software", r"\bsgi\s+free\s+software\s+licen[sc]e\s+b"),
    ("spl-1.0", "sun public licen", r"\bsun\s+public\s+licen[sc]e"),
    ("tcl", "tcl/tk licen|tcl licen", r"\btcl(?:/tk)?\s+licen[sc]e"),
    ("vsl-1.0", "vovida software", r"vovida\s+software\s+licen[sc]e"),
    ("watcom-1.0", "sybase open watcom", r"sybase\s+open\s+watcom\s+public\s+licen[sc]e"),
    ("zpl-2.1", "zope public", rf"zope\s+public\s+licen[sc]e(?:{_V}2\.1)?"),
    ("zend-2.0", "zend licen|zend engine licen", r"\bzend\s+(?:engine\s+)?licen[sc]e"),
    ("bittorrent-1.1", "bittorrent open", r"bittorrent\s+open\s+source\s+licen[sc]e"),
    ("condor-1.1", "condor public", r"condor\s+public\s+licen[sc]e"),
    ("dsl-1.0", "design science", r"design\s+science\s+licen[sc]e"),
    ("etalab-2.0", "licence ouverte", r"licence\s+ouverte(?:\s*/\s*open\s+licen[sc]e)?"),
    ("parity-7.0.0", "parity public", r"parity\s+public\s+licen[sc]e"),
    ("polyform-nc-1.0.0", "polyform noncommercial", r"polyform\s+noncommercial\s+licen[sc]e"),
    ("polyform-sb-1.0.0", "polyform small", r"polyform\s+small\s+business\s+licen[sc]e"),
    ("hippocratic-2.1", "hippocratic licen", r"\bhippocratic\s+licen[sc]e"),
    ("anti-996", "anti 996", r"\banti[ -]996(?:\s+licen[sc]e)?"),
    ("cdla-permissive-2.0", "community data licen", r"community\s+data\s+licen[sc]e\s+agreement\s*[-,]?\s*permissive"),
    ("cdla-sharing-1.0", "community data licen", r"community\s+data\s+licen[sc]e\s+agreement\s*[-,]?\s*sharing"),
]

#: Names without a version, abbreviations and wordings.
MENTIONS: list[tuple[str, str, str]] = [
    ("gpl", "general public", r"gnu\s+general\s+public\s+licen[sc]e"),
    ("lgpl", "lesser general", r"gnu\s+lesser\s+general\s+public\s+licen[sc]e"),
    ("lgpl", "library general", r"gnu\s+library\s+general\s+public\s+licen[sc]e"),
    ("agpl", "affero", r"(?:gnu\s+)?affero\s+general\s+public\s+licen[sc]e"),
    ("gfdl", "free documentation", r"(?:gnu\s+)?free\s+documentation\s+licen[sc]e"),
    ("gpl-2.0", "gpl", r"(?<![a-z])gpl[ -]?v?2(?:\.0)?(?:-only)?(?![\d.]*\d|\+|-or)"),
    ("gpl-2.0-or-later", "gpl", r"(?<![a-z])gpl[ -]?v?2(?:\.0)?(?:\+|-or-later)"),
    ("gpl-3.0", "gpl", r"(?<![a-z])gpl[ -]?v?3(?:\.0)?(?:-only)?(?![\d.]*\d|\+|-or)"),
    ("gpl-3.0-or-later", "gpl", r"(?<![a-z])gpl[ -]?v?3(?:\.0)?(?:\+|-or-later)"),
    ("lgpl-2.1", "lgpl", r"\blgpl[ -]?v?2\.1(?:\+|-only|-or-later)?"),
    ("lgpl-3.0", "lgpl", r"\blgpl[ -]?v?3(?:\.0)?(?:\+|-only|-or-later)?"),
    ("agpl-3.0", "agpl", r"\bagpl[ -]?v?3(?:\.0)?(?:\+|-only|-or-later)?"),
    ("gpl", "gpl", r"\bgpl(?:'d|ed)?\b"),
    ("lgpl", "lgpl", r"\blgpl\b"),
    ("agpl", "agpl", r"\bagpl\b"),
    ("apache", "apache", r"apache\s+(?:software\s+)?licen[sc]e"),
    ("apache-2.0", "apache", r"\bapache[ -]2(?:\.0)?\b"),
    ("asl", "asl2|asl 2", r"\basl[ -]?2(?:\.0)?\b"),
    ("mit", "mit licen", r"\bmit\s+licen[sc]e"),
    ("mit", "expat licen|mit/x11|mit style licen|mit licensed", r"\b(?:expat\s+licen[sc]e|mit/x11|mit[ -]style\s+licen[sc]e|mit-licensed)"),
    ("mit", "permission is hereby", r"permission\s+is\s+hereby\s+granted,\s+free\s+of\s+charge,\s+to\s+any\s+person"),
    ("isc", "permission to use", r"permission\s+to\s+use,\s+copy,\s+modify,\s+and/or\s+distribute\s+this\s+software\s+for\s+any\s+purpose"),
    ("bsd", "bsd", r"\bbsd(?:[ -]style|[ -]type)?\s+licen[sc]e"),
    ("bsd", "redistribution and use", r"redistribution\s+and\s+use\s+in\s+source\s+and\s+binary\s+forms"),
    ("bsd-3-clause", "endorse or promote", r"may\s+be\s+used\s+to\s+endorse\s+or\s+promote\s+products\s+derived"),
    ("cc-by", "cc by", r"\bcc[ -]by\b"),
    ("cc-by-sa", "cc by", r"\bcc[ -]by[ -]sa\b"),
    ("cc-by-nc", "cc by", r"\bcc[ -]by[ -]nc\b"),
    ("cc-by-nd", "cc by", r"\bcc[ -]by[ -]nd\b"),
    ("cc-by-nc-sa", "cc by", r"\bcc[ -]by[ -]nc[ -]sa\b"),
    ("cc-by-nc-nd", "cc by", r"\bcc[ -]by[ -]nc[ -]nd\b"),
    ("cc-by", "creative commons", r"creative\s+commons\s+attribution(?:\s+licen[sc]e)?"),
    ("cc-by-sa", "creative commons", r"creative\s+commons\s+attribution[ -]share[ -]?alike"),
    ("cc-by-nc", "creative commons", r"creative\s+commons\s+attribution[ -]non-?commercial"),
    ("creative-commons", "creative commons", r"creative\s+commons(?:\s+licen[sc]e)?"),
    ("mpl", "mozilla public", r"mozilla\s+public\s+licen[sc]e"),
    ("mpl-2.0", "mpl2|mpl 2", r"\bmpl[ -]?2(?:\.0)?\b"),
    ("epl", "eclipse public", r"eclipse\s+public\s+licen[sc]e"),
    ("cddl", "cddl", r"\bcddl\b"),
    ("eupl", "eupl", r"\beupl\b"),
    ("artistic", "artistic licen", r"artistic\s+licen[sc]e"),
    ("osl", "open software", r"open\s+software\s+licen[sc]e"),
    ("afl", "academic free", r"academic\s+free\s+licen[sc]e"),
    ("public-domain", "public domain", r"(?:released|placed|dedicated|is|are)\s+(?:in(?:to)?|to)\s+the\s+public\s+domain"),
    ("public-domain", "public domain", r"\bpublic\s+domain\b"),
    ("proprietary", "all rights reserved", r"all\s+rights\s+reserved"),
    ("proprietary", "proprietary and confidential|proprietary licen|proprietary software", r"proprietary\s+(?:and\s+confidential|licen[sc]e|software)"),
    ("proprietary", "confidential and proprietary", r"confidential\s+and\s+proprietary"),
    ("commercial", "commercial licen", r"commercial\s+licen[sc]e"),
    ("eula", "end user licen", r"end[ -]user\s+licen[sc]e\s+agreement"),
    ("free-unknown", "licen", r"(?:released|licensed|distributed|published)\s+under\s+(?:an?\s+)?(?:open|free)[ -](?:source\s+|software\s+)?licen[sc]e"),
    ("dual-license", "licen", r"dual(?:ly)?[ -]licen[sc]ed"),
]

#: Links to license texts.
LINKS: list[tuple[str, str, str]] = [
    ("apache-2.0", "apache.org", r"apache\.org/licenses/license-2\.0"),
    ("apache-1.1", "apache.org", r"apache\.org/licenses/license-1\.1"),
    ("gpl-2.0", "gnu.org", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"),
    ("gpl-3.0", "gnu.org", r"gnu\.org/licenses/gpl-3\.0"),
    ("gpl", "gnu.org", r"gnu\.org/(?:licenses|copyleft)/gpl(?!-)"),
    ("lgpl-2.1", "gnu.org", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"),
    ("lgpl-3.0", "gnu.org", r"gnu\.org/licenses/lgpl-3\.0"),
    ("agpl-3.0", "gnu.org", r"gnu\.org/licenses/agpl-3\.0"),
    ("gfdl", "gnu.org", r"gnu\.org/(?:licenses|copyleft)/fdl"),
    ("mit", "opensource.org", r"opensource\.org/licenses?/mit\b"),
    ("bsd-2-clause", "opensource.org", r"opensource\.org/licenses?/bsd-2-clause"),
    ("bsd-3-clause", "opensource.org", r"opensource\.org/licenses?/bsd-3-clause"),
    ("isc", "opensource.org", r"opensource\.org/licenses?/isc"),
    ("artistic-2.0", "opensource.org", r"opensource\.org/licenses?/artistic-2\.0"),
    ("mpl-2.0", "mozilla.org", r"mozilla\.org/(?:en-us/)?mpl/2\.0"),
    ("epl-1.0", "eclipse.org", r"eclipse\.org/legal/epl-v10"),
    ("epl-2.0", "eclipse.org", r"eclipse\.org/legal/epl-(?:v20|2\.0)"),
    ("cc0-1.0", "creativecommons.org", r"creativecommons\.org/publicdomain/zero/1\.0"),
    ("public-domain", "creativecommons.org", r"creativecommons\.org/publicdomain/mark"),
    ("cc-by", "creativecommons.org", r"creativecommons\.org/licenses/by/[1-4]\.[05]"),
    ("cc-by-sa", "creativecommons.org", r"creativecommons\.org/licenses/by-sa/[1-4]\.[05]"),
    ("cc-by-nd", "creativecommons.org", r"creativecommons\.org/licenses/by-nd/[1-4]\.[05]"),
    ("cc-by-nc", "creativecommons.org", r"creativecommons\.org/licenses/by-nc/[1-4]\.[05]"),
    ("cc-by-nc-sa", "creativecommons.org", r"creativecommons\.org/licenses/by-nc-sa/[1-4]\.[05]"),
    ("cc-by-nc-nd", "creativecommons.org", r"creativecommons\.org/licenses/by-nc-nd/[1-4]\.[05]"),
    ("unlicense", "unlicense.org", r"unlicense\.org"),
    ("wtfpl", "wtfpl", r"wtfpl\.net"),
    ("bsl-1.0", "boost.org", r"boost\.org/license_1_0"),
    ("ofl-1.1", "scripts.sil.org", r"scripts\.sil\.org/ofl"),
    ("odbl-1.0", "opendatacommons", r"opendatacommons\.org/licenses/odbl"),
    ("pddl-1.0", "opendatacommons", r"opendatacommons\.org/licenses/pddl"),
]

TAG, TITLE, LINK, MENTION = 4, 3, 2, 1
#: How sure a detection of each priority is; a base phrase counts as a mention.
SURE = {TAG: 1.0, TITLE: 0.9, LINK: 0.8, MENTION: 0.6}


def rules() -> list[tuple[int, str, str, str]]:
    """(priority, label, keywords, expression), in order."""
    names = sorted({label for label, _, _ in [*TITLES, *MENTIONS]})
    # one tag rule per label: the tag, then the label as SPDX writes it
    out = [(TAG, n, "spdx license identifier", rf"spdx-license-identifier:\s*\(?\s*{re.escape(n)}(?![\w.+-])") for n in names]
    out += [(TAG, f"{n}-or-later", "spdx license identifier", rf"spdx-license-identifier:\s*\(?\s*{re.escape(n)}\+") for n in names if n.startswith(("gpl-", "lgpl-", "agpl-")) and not n.endswith("later")]
    return out + [(p, *r) for p, group in ((TITLE, TITLES), (LINK, LINKS), (MENTION, MENTIONS)) for r in group]


def folded(text: Column) -> Column:
    """Lower case; 'cc-by' and other breaks before keywords are taken care of by the rules."""
    return F.lower(text)


def together(words: set[str]) -> str:
    """One expression for the places where any of the words begins, letter by letter; a blank is white space or hyphens."""
    if "" in words:
        return ""
    rest: dict[str, set[str]] = {}
    for w in words:
        rest.setdefault(w[0], set()).add(w[1:])
    ways = [(r"[\s-]+" if first == " " else re.escape(first)) + together(more) for first, more in sorted(rest.items())]
    return ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"


def keywords(rule: tuple[int, str, str, str]) -> list[str]:
    return rule[2].split("|")


#: What a text in lower case must hold for any rule to be tried, and for any base phrase.
GATE = together({k for rule in rules() for k in keywords(rule)})
BASE_GATE = r"license|cc[^a-z0-9]+by"


def base_places(words: Column) -> Column:
    """start and label of each place of a base phrase."""
    def at(w: Column) -> Column:
        def hits(phrase: tuple[str, ...], label: str) -> Column:
            starts = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: reduce(and_, [F.get(w, i + k).eqNullSafe(F.lit(p)) for k, p in enumerate(phrase)]))
            return F.transform(starts, lambda i: F.struct(i.cast("long").alias("start"), F.lit(label).alias("label")))

        return F.when(F.size(w) > 0, F.concat(*[hits(*x) for x in BASE])).otherwise(F.expr("cast(array() as array<struct<start:bigint,label:string>>)"))

    return let(words, at)


def detections(low: Column) -> Column:
    """begin, end, priority (negative), rule and label of every match of the rules of which the text holds a keyword."""
    groups: dict[str, list[dict]] = {}
    for k, (p, n, w, x) in enumerate(rules()):
        groups.setdefault(w, []).append({"p": p, "k": k, "n": n, "x": x})
    # one constant, which the optimiser makes of its JSON
    table = F.from_json(F.lit(json.dumps([{"w": w.split("|"), "rules": group} for w, group in groups.items()])), "array<struct<w:array<string>,rules:array<struct<p:int,k:int,n:string,x:string>>>>")

    def places(text: Column, rule: Column) -> Column:
        """Lengths of the text between matches and of the matches give the places."""
        def built(parts: Column, found: Column) -> Column:
            start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<begin:int,end:int,p:int,k:int,n:string>>)").alias("all"))
            lengths = F.zip_with(F.slice(parts, 1, F.size(found)), found, lambda a, b: F.struct(F.length(a).alias("gap"), F.length(b).alias("size")))
            one = lambda s, x: F.struct((s["at"] + x["gap"] + x["size"]).alias("at"), F.concat(s["all"], F.array(F.struct((s["at"] + x["gap"]).alias("begin"), (s["at"] + x["gap"] + x["size"]).alias("end"), (-rule["p"]).alias("p"), rule["k"].alias("k"), rule["n"].alias("n")))).alias("all"))
            return F.aggregate(lengths, start, one, lambda s: s["all"])

        return let(F.struct(F.split(text, rule["x"], -1).alias("a"), F.regexp_extract_all(text, rule["x"], F.lit(0)).alias("b")), lambda y: built(y["a"], y["b"]))

    def of(text: Column) -> Column:
        plain = F.regexp_replace(text, r"[\s-]+", " ")
        tried = let(plain, lambda t: F.filter(table, lambda g: F.exists(g["w"], lambda w: F.contains(t, w))))
        return F.flatten(F.flatten(F.transform(tried, lambda g: F.transform(g["rules"], lambda r: places(text, r)))))

    return let(low, of)


def surviving(found: Column) -> Column:
    """labels and the best priority of what no other detection of at least that priority contains.

    Sorted by begin, then by end backwards, an interval lies within an earlier
    one if that one's end is not smaller; the largest end so far is kept for each
    priority and those above it.
    """
    order = F.array_sort(F.transform(found, lambda d: F.struct(d["begin"].alias("begin"), (-d["end"]).alias("back"), d["p"].alias("p"), d["k"].alias("k"), d["n"].alias("n"))))
    levels = sorted(SURE)
    start = F.struct(*[F.lit(-1).alias(f"e{p}") for p in levels], F.expr("cast(array() as array<string>)").alias("labels"), F.lit(0).alias("best"))

    def step(s: Column, d: Column) -> Column:
        p, end = -d["p"], -d["back"]
        reach = F.lit(-1)
        for level in levels:
            reach = F.when(p <= level, F.greatest(reach, s[f"e{level}"])).otherwise(reach)
        free = reach < end
        return F.struct(
            *[F.when(p == level, F.greatest(s[f"e{level}"], end)).otherwise(s[f"e{level}"]).alias(f"e{level}") for level in levels],
            F.when(free & ~F.array_contains(s["labels"], d["n"]), F.concat(s["labels"], F.array(d["n"]))).otherwise(s["labels"]).alias("labels"),
            F.when(free, F.greatest(s["best"], p)).otherwise(s["best"]).alias("best"),
        )

    return F.aggregate(order, start, step)


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    low = docs.select("doc_id", text.alias("text"), folded(text).alias("low"))
    found = let(surviving(detections(F.col("low"))), lambda s: F.struct(s["labels"].alias("labels"), s["best"].alias("best")))
    text = F.col("text")
    words = F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.lower(w))
    rows = low.select(
        "doc_id", F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"),
        F.struct(F.when(F.col("low").rlike(BASE_GATE), base_places(words)).alias("base"), F.when(F.col("low").rlike(GATE), found).alias("rest")).alias("v"),
    )
    base = F.coalesce(F.col("v.base"), F.expr("cast(array() as array<struct<start:bigint,label:string>>)"))
    own = F.array_sort(F.array_distinct(F.transform(base, lambda x: x["label"])))
    more = F.coalesce(F.col("v.rest.labels"), F.expr("cast(array() as array<string>)"))
    best = F.coalesce(F.col("v.rest.best"), F.lit(0))
    score = F.lit(0.0)
    for p, sure in sorted(SURE.items()):
        score = F.when(best == p, F.lit(sure)).otherwise(score)
    score = F.greatest(score, F.when(F.size(base) > 0, F.lit(SURE[MENTION])).otherwise(F.lit(0.0)))
    starts = F.transform(base, lambda x: x["start"])
    return rows.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(own, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(own, more)), ",").alias("labels"),
        score.alias("score"),
    )
