"""Regular expressions used by the text functions.

White space is the Unicode set plus the four separators U+001C..U+001F, digits are category Nd, word characters are
letters, numbers and the underscore.
"""

from __future__ import annotations

WHITE_CHARS = "".join(
    chr(c)
    for c in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B)]
    + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
WS = r"(?U:[\s\x{1C}-\x{1F}])"
NOT_WS = r"(?U:[^\s\x{1C}-\x{1F}])"
WORD = r"[\p{L}\p{N}_]"

# Fixed format: day/month/year, hour:minute am|pm - , each blank being exactly one white-space character.
HEADER = (
    r"\p{Nd}{1,2}/\p{Nd}{1,2}/\p{Nd}{2,4}," + WS + r"\p{Nd}{1,2}:\p{Nd}{2}" + WS + "[ap]m" + WS + "-" + WS
)

SENDER = rf"(?s)\A(.+?):{WS}"
# Anchored to the end of the match before, which keeps the search linear.
LATER_SENDER = rf"(?s)\G(.+?):{WS}"

MEDIA = rf"(?i)<media{WS}+omitted>"
LINKS = f"http{NOT_WS}+|www{NOT_WS}+"

INDIC = r"[\x{0900}-\x{09FF}]"
BENGALI = r"[\x{0980}-\x{09FF}]"
DEVANAGARI = r"[\x{0900}-\x{097F}]"
LATIN = "[a-zA-Z0-9]"

# Candidate links: anything with a scheme or www, or a dotted name with an optional path. A dotted name only
# counts when its last label is one of the listed top-level domains.
_URL_TAIL = r'(?U:[^\s\x{1C}-\x{1F}<>"])'
_NAME = r"[\p{L}\p{N}@_-]"
# A name is tried from its first character only, so long words without a dot cost one pass.
URL_CANDIDATE = (
    rf"(?i)(?:https?://|ftp://|www\.){_URL_TAIL}+"
    rf"|(?<!{_NAME}){_NAME}++(?:\.{_NAME}++)+(?:[/?#:]{_URL_TAIL}*)?"
)
# What every link contains.
URL_HINT = r"\.(?U:[^\s\x{1C}-\x{1F}])|://"
URL_SCHEME = r"(?i)\A(?:https?://|ftp://|www\.)"
# Frequent top-level domains, recognised without a scheme where the caller brings no list. The registry has
# some 1,500; a job that needs them all passes them to text.urls, which looks labels up by hash (see README).
TOP_LEVEL_DOMAINS = (
    "com|org|net|edu|gov|mil|int|info|biz|io|co|ai|app|dev|me|tv|ly|gl|gg|xyz|online|site|store|shop|tech|blog|cloud"
    "|in|uk|us|ca|au|de|fr|it|es|nl|be|ch|at|se|no|dk|fi|pl|pt|ie|cz|gr|ru|ua|tr|cn|jp|kr|tw|hk|sg|my|id|th|vn|ph"
    "|bd|pk|lk|np|ae|sa|il|za|ng|ke|eg|br|mx|ar|cl|pe|nz|eu"
    "|club|news|live|world|today|life|media|agency|group|company|team|email|digital|network|studio|design|art|games|video"
    "|music|travel|health|care|money|finance|bank|law|academy|school|university|center|support|guide|zone|city|one|top|pro"
    "|name|mobi|aero|museum|jobs|asia|space|fun|link|page|wiki|social|chat|work|works|tools|software|host|website"
    "|icu|sbs|photography|cyou|cfd|bond|buzz|vip|win"
).split("|")


# The last label of a bare domain's host name; empty where the text is no such domain.
URL_LABEL = r"\A[^@/?#:]*\.([^@/?#:.]+)(?:[/?#:]|\z)"

# Single code points with the Unicode Emoji property, without the keycap bases and the regional
# indicators, which are emoji only as part of a sequence.
_EMOJI = """
A9 AE 203C 2049 2122 2139 2194-2199 21A9-21AA 231A-231B 2328 23CF 23E9-23F3 23F8-23FA 24C2 25AA-25AB 25B6 25C0
25FB-25FE 2600-2604 260E 2611 2614-2615 2618 261D 2620 2622-2623 2626 262A 262E-262F 2638-263A 2640 2642 2648-2653
265F-2660 2663 2665-2666 2668 267B 267E-267F 2692-2697 2699 269B-269C 26A0-26A1 26A7 26AA-26AB 26B0-26B1 26BD-26BE
26C4-26C5 26C8 26CE-26CF 26D1 26D3-26D4 26E9-26EA 26F0-26F5 26F7-26FA 26FD 2702 2705 2708-270D 270F 2712 2714 2716
271D 2721 2728 2733-2734 2744 2747 274C 274E 2753-2755 2757 2763-2764 2795-2797 27A1 27B0 27BF 2934-2935 2B05-2B07
2B1B-2B1C 2B50 2B55 3030 303D 3297 3299 1F004 1F0CF 1F170-1F171 1F17E-1F17F 1F18E 1F191-1F19A 1F201-1F202 1F21A
1F22F 1F232-1F23A 1F250-1F251 1F300-1F321 1F324-1F393 1F396-1F397 1F399-1F39B 1F39E-1F3F0 1F3F3-1F3F5 1F3F7-1F4FD
1F4FF-1F53D 1F549-1F54E 1F550-1F567 1F56F-1F570 1F573-1F57A 1F587 1F58A-1F58D 1F590 1F595-1F596 1F5A4-1F5A5 1F5A8
1F5B1-1F5B2 1F5BC 1F5C2-1F5C4 1F5D1-1F5D3 1F5DC-1F5DE 1F5E1 1F5E3 1F5E8 1F5EF 1F5F3 1F5FA-1F64F 1F680-1F6C5
1F6CB-1F6D2 1F6D5-1F6D7 1F6DC-1F6E5 1F6E9 1F6EB-1F6EC 1F6F0 1F6F3-1F6FC 1F7E0-1F7EB 1F7F0 1F90C-1F93A 1F93C-1F945
1F947-1F9FF 1FA70-1FA7C 1FA80-1FA88 1FA90-1FABD 1FABF-1FAC5 1FACE-1FADB 1FAE0-1FAE8 1FAF0-1FAF8
"""
_SINGLE_EMOJI = (
    "["
    + "".join("-".join(rf"\x{{{end}}}" for end in span.split("-")) for span in _EMOJI.split())
    + "]"
)

# The look-ahead spares ordinary letters the long range list.
EMOJI = r"(?=[\x{A9}\x{AE}\x{203C}-\x{1FAFF}])" + _SINGLE_EMOJI

# Word-cloud terms: at least two characters, apostrophes allowed after the first, no plain number or its possessive.
_TERM_PART = r"[\p{L}\p{N}_']"
TERM = rf"(?!\p{{Nd}}+(?:'s)?(?!{_TERM_PART})){WORD}{_TERM_PART}+"
# Sentiment tokens: what is left after dropping everything but letters, digits, the apostrophe and white space.
NOT_TOKEN = r"(?U:[^\p{L}\p{N}'\s\x{1C}-\x{1F}]+)"
