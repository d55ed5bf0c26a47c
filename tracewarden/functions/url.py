"""Whether a text is an absolute URL by the rules of the public URL standard, as one expression.

Judged are the scheme, credentials, host (names, percent escapes, IPv4 numbers in all their spellings, IPv6) and port; nothing
after the host can make a URL invalid.  Names outside ASCII are taken as they are: their mapping to ASCII can't be
expressed, so such a name is refused only for the characters that no name may have.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the standard: schemes with a host, and characters that no host, or no name, may have.
SPECIAL = ("http", "https", "ws", "wss", "ftp")
NOT_IN_HOST, NOT_IN_NAME = r"[\x00\t\n\r #/:<>?@\[\\\]^|]", r"[\x00-\x20#/:<>?@\[\\\]^|%\x7f]"
SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"
PORTS = 65535
_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
DOTTED = rf"{_OCTET}(\.{_OCTET}){{3}}$"


def ipv6() -> str:
    """An IPv6 address whose dotted end, if any, is written as two groups: eight groups, or fewer around one gap."""
    g = "[0-9A-Fa-f]{1,4}"
    gaps = [(f"{g}(:{g}){{{i - 1}}}" if i else "") + "::" + (f"({g}(:{g}){{0,{6 - i}}})?" if i < 7 else "") for i in range(8)]
    return f"^({'|'.join([f'{g}(:{g}){{7}}', *gaps])})$"


def _number(x: Column) -> Column:
    """The value of a part of an IPv4 address, null if it is none."""
    wide = lambda c: F.try_to_number(c, F.lit("9" * 20))
    hex_ = F.conv(F.concat(F.lit("0"), F.substring(x, 3, 1 << 20)), 16, 10)
    value = F.when(x.rlike("^0[xX][0-9A-Fa-f]*$"), hex_).when(x.rlike("^0[0-7]+$"), F.conv(x, 8, 10)).when(x.rlike("^(0|[1-9][0-9]*)$"), F.when(F.length(x) > 12, F.lit("9" * 12)).otherwise(x))
    return F.coalesce(wide(value), F.when(value.isNotNull(), F.lit(10**12).cast("decimal(20,0)")))


def _ipv4_fails(host: Column) -> Column:
    """Whether a host whose last part is a number is no IPv4 address; false for other hosts."""
    parts = F.split(F.regexp_replace(host, r"\.$", ""), r"\.", -1)
    n, last = F.size(parts), F.element_at(parts, -1)
    numeric = last.rlike("^([0-9]+|0[xX][0-9A-Fa-f]*)$")
    values = F.transform(parts, _number)
    most = F.element_at(F.array(*(F.lit(256 ** (5 - k)).cast("decimal(20,0)") for k in range(1, 5))), F.least(n, F.lit(4)))
    low = F.exists(F.slice(values, 1, F.greatest(n - 1, F.lit(0))), lambda v: v > 255)
    return numeric & ((n > 4) | F.exists(values, lambda v: v.isNull()) | F.coalesce(low | (F.element_at(values, -1) >= most), F.lit(True)))


def _host_fails(host: Column, named: bool) -> Column:
    """Whether a host is none: ``named`` ones are names or IPv4 addresses, others only free of some characters."""
    inside = F.regexp_extract(host, r"^\[(.*)\]$", 1)
    dotted = F.regexp_replace(inside, rf"(^|:){DOTTED}", "$10:0")
    six = ~dotted.rlike(ipv6())
    if not named:
        return F.when(host.startswith("["), six).otherwise(host.rlike(NOT_IN_HOST))
    name = F.try_url_decode(F.replace(host, F.lit("+"), F.lit("%2B")))
    bad = host.rlike("%(?![0-9A-Fa-f]{2})") | name.isNull() | (name == "") | name.rlike(NOT_IN_NAME) | _ipv4_fails(name)
    return F.when(host.startswith("["), six).otherwise(F.coalesce(bad, F.lit(True)))


def _authority_fails(authority: Column, named: bool) -> Column:
    """Whether [credentials@]host[:port] is none."""
    there = F.contains(authority, F.lit("@"))
    after = F.regexp_replace(authority, "^.*@", "")
    host = F.regexp_extract(after, r"(?s)^(\[[^\]]*\]|[^:\[]*|[^:]*\[.*?)(:.*)?$", 1)
    port = F.regexp_extract(after, r"(?s)^(\[[^\]]*\]|[^:\[]*)(:(.*))?$", 3)
    whole = after.rlike(r"(?s)^(\[[^\]]*\]|[^:\[]*)(:.*)?$")
    number = F.regexp_replace(port, "^0+", "")
    port_fails = port.rlike("[^0-9]") | (F.length(number) > 5) | F.coalesce(number.try_cast("int") > PORTS, F.lit(False))
    empty = (host == "") & (F.lit(named) | there | F.contains(after, F.lit(":")))
    return ~whole | empty | port_fails | (F.when(host == "", F.lit(False)).otherwise(_host_fails(host, named)))


def url_fails(text: Column) -> Column:
    """Whether a text is no absolute URL; null is none."""
    url = F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x00-\x20]+|[\x00-\x20]+$", ""), "\t\n\r", "")
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    rest = F.regexp_replace(url, SCHEME, "")
    special = _authority_fails(F.regexp_extract(rest, r"^[/\\]*([^/\\?#]*)", 1), True)
    drive = F.regexp_extract(rest, r"^[/\\]{2}([^/\\?#]*)", 1)
    file_ = (drive != "") & ~drive.rlike("^[A-Za-z][:|]$") & _host_fails(drive, True)
    other = rest.startswith("//") & _authority_fails(F.regexp_extract(rest, "^//([^/?#]*)", 1), False)
    return F.when(scheme == "", True).when(scheme.isin(*SPECIAL), special).when(scheme == "file", file_).otherwise(other)


def is_http(text: Column) -> Column:
    """Whether a URL's scheme is http or https."""
    return F.translate(F.coalesce(text, F.lit("")), "\t\n\r", "").rlike(r"(?i)^[\x00-\x20]*https?:")


#: URLs and whether the standard's parser accepts them, each kind of rule from both sides.
EXAMPLES: list[tuple[str, bool]] = [
    ("https://example.com/a/b", True), ("HTTP://EXAMPLE.COM", True), ("http:example.com", True), ("http:/example.com", True), ("http:\\\\example.com\\x", True), ("https:////example.com", True),
    (" \t https://example.com/  ", True), ("ht\ttp://exa\nmple.com", True), ("http://exa mple/x", False), ("http://a b", False), ("http://", False), ("http:", False), ("https://?q", False), ("http:///", False), ("nothing", False), ("", False), ("//example.com", False), ("1http://x", False), ("h-t.t+p:x", True), (":x", False),
    ("http://user@example.com", True), ("http://user:pw@example.com:8080/", True), ("http://a@b@c.example", True), ("https://user@:80/", False), ("http://@/", False), ("http://user@", False), ("http://:80/", False),
    ("http://x:80", True), ("http://x:", True), ("http://x:0", True), ("http://x:65535", True), ("http://x:65536", False), ("http://x:99999/", False), ("http://x:00080", True), ("http://x:8a", False), ("http://x:-1", False), ("http://x:80:80", False),
    ("http://1.2.3.4", True), ("http://1.2.3.999/", False), ("http://1.2.3", True), ("http://1.2.65536", False), ("http://1.2.65535", True), ("http://4294967295", True), ("http://4294967296", False), ("http://0x7f.1", True), ("http://0x", True), ("http://0xg", True), ("http://09", False), ("http://010.1", True), ("http://256.1", False), ("http://1.2.3.4.5", False), ("http://1.2.3.4.", True), ("http://a.1", False), ("http://1.a", True), ("http://1..2", False), ("http://a..b", True), ("http://.", True), ("http://99999999999999999999999", False),
    ("http://[::1]", True), ("http://[::1", False), ("http://::1", False), ("http://[1:2:3:4:5:6:7:8]", True), ("http://[1:2:3:4:5:6:7:8:9]", False), ("http://[1::2::3]", False), ("http://[::ffff:1.2.3.4]:80/", True), ("http://[::1.2.3.256]", False), ("http://[1:2:3:4:5:6:7::]", True), ("http://[::1%25eth0]", False), ("http://[]", False), ("http://[::1]x", False), ("http://a[b]", False),
    ("https://%zz/", False), ("http://%41.example", True), ("http://a%20b", False), ("http://a%", False), ("http://a%00b", False), ("https://a|b", False), ("http://a<b", False), ("http://a^b", False), ("http://a`b", True), ("http://a_b~c!$&'()*+,;=d", True), ("http://%31.2.3.999", False),
    ("http://x/%zz", True), ("http://x?a b|c", True), ("http://x#<>", True),
    ("ftp://x", True), ("ftp://", False), ("ws://x:70000", False), ("mailto:a b", True), ("javascript:alert(1)", True), ("foo://", True), ("foo://a b", False), ("foo://x:80a", False), ("foo://:80", False), ("foo://u@", False), ("foo://a%zz", True), ("file:///etc", True), ("file://C:/x", True), ("file://a:80/", False), ("data:,x", True),
]
