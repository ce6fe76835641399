"""What a credential looks like: patterns by the grammar they follow, and the judges of the literal values they find.

The grammars are: known key formats, name-operator-value, lookup defaults, call arguments, headers, addresses with user
data, commands, and remarks that hand out an account. A pattern only points at a value; whether the value would grant
access is judged on the value as a whole.
"""

from __future__ import annotations

import base64
import math
import re
from collections import Counter
from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    kind: str  # how the value is judged: key, prefixed, token, password, either, bare, basic, strong, webhook


# Words that end the name of a stored credential.
_NAME = r"(?:passwords?|passwd|passphrase|passwort|kennwort|contrase(?:ñ|n)a|pwd|pass|[_.]pw|secret|secret[_-]?key|token|api[_-]?key|access[_-]?key|account[_-]?key|private[_-]?key|signing[_-]?key|encryption[_-]?key|auth[_-]?key|credentials?|creds)"
_TAIL = r"[\w.\]-]{0,20}?"
# Between a name and its value: quotes and brackets that close the name, a type, an operator.
_SHUT = r"""["'`]?[\])]{0,2}(?:\s{0,3}:\s{0,2}[a-z][\w<>\[\].?|]{1,30}(?=\s{0,3}=)|\s{1,3}[a-z][\w.\[\]]{1,20}(?=\s{1,3}=))?"""
_STR = r"""(?:[brfu@]{0,2}["'`])"""
_BARE = r"""[^\s"'`;,(){}<>\[\]]"""
_QUOTED_WORD = r"""["'][^"'\r\n]{0,80}["']"""
_ACCOUNT = r"(?:log(?:ged)?[ -]?in|login|sign(?:ed)?[ -]?in|account|user|credentials?|creds|needs?|access|connect(?:s|ed)?|ssh|auth(?:enticate)?|anmeld\w{0,6}|zugang\w{0,8}|konto|benutzer|acceso|cuenta|usuario|entrar|conectar|compte|demo|admin|host|server)"

# The public formats of issued keys.
_ISSUED = r"(?:gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{22,}|gl(?:pat|dt|rt|cbt|ptt|ft|imt|agent|oas|soat)-[A-Za-z0-9_.-]{20,}|npm_[A-Za-z0-9]{30,}|hf_[A-Za-z0-9]{30,}|pypi-[A-Za-z0-9_-]{50,}|do[opr]_v1_[a-f0-9]{64}|SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}|shp(?:at|ss|ca|pa)_[a-fA-F0-9]{32}|ya29\.[A-Za-z0-9_-]{20,}|whsec_[A-Za-z0-9+/=]{20,}|hv[sbr]\.[A-Za-z0-9_-]{20,}|dapi[a-f0-9]{32}|AGE-SECRET-KEY-1[A-Za-z0-9]{50,}|lin_api_[A-Za-z0-9]{32,}|figd_[A-Za-z0-9_-]{32,}|NRAK-[A-Za-z0-9]{20,}|PMAK-[A-Za-z0-9-]{50,}|rubygems_[a-f0-9]{40,}|sntry[su]_[A-Za-z0-9_=+/-]{40,}|xkeysib-[a-f0-9]{60,}[A-Za-z0-9-]*|nvapi-[A-Za-z0-9_-]{50,}|gsk_[A-Za-z0-9]{40,}|pplx-[A-Za-z0-9]{40,}|sq0(?:atp|csp)-[A-Za-z0-9_-]{20,}|EAACEdEose0cBA[A-Za-z0-9]+|ATATT3[A-Za-z0-9_=-]{50,}|dckr_pat_[A-Za-z0-9_-]{20,}|tskey-[a-z]+-[A-Za-z0-9-]{20,}|sbp_[a-f0-9]{40}|pul-[a-f0-9]{40}|glsa_[A-Za-z0-9_]{32,}|ops_eyJ[A-Za-z0-9_-]{50,}|fio-u-[A-Za-z0-9_=-]{40,}|key-[a-f0-9]{32}|access_token\$production\$[a-z0-9]{16}\$[a-f0-9]{32})"

RULES = [
    Rule("private_key", r"(-----BEGIN (?:[A-Z0-9]{2,12} ){0,3}PRIVATE KEY(?: BLOCK)?-----)", "key"),
    Rule("aws_id", r"(?<![A-Z0-9])((?-i:AKIA|ASIA)(?-i:[A-Z0-9]{16}))(?![A-Za-z0-9])", "prefixed"),
    Rule("issued", r"(?<![A-Za-z0-9])(" + _ISSUED + ")", "prefixed"),
    Rule("chat_token", r"(?<![A-Za-z0-9])((?:xox[abceoprs]|xapp)-[A-Za-z0-9-]{10,})", "prefixed"),
    Rule("service_key", r"(?<![A-Za-z0-9_-])((?:sk|rk)[-_](?:live[-_]|proj[-_]|test[-_]|ant[-_])?[A-Za-z0-9_-]{20,})", "prefixed"),
    Rule("cloud_key", r"(?<![A-Za-z0-9_-])((?-i:AIza)[A-Za-z0-9_-]{35})(?![A-Za-z0-9_-])", "prefixed"),
    Rule("bot_token", r"(?<![A-Za-z0-9:])(\d{8,10}:(?-i:AA)[A-Za-z0-9_-]{32,33})(?![A-Za-z0-9_-])", "prefixed"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])((?-i:eyJ)[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", "prefixed"),
    Rule("webhook", r"https://(?:hooks\.slack\.com/(?:services|workflows|triggers)/([A-Za-z0-9/_+-]{20,})|(?:[a-z]{1,10}\.)?discord(?:app)?\.com/api/webhooks/\d{5,}/([A-Za-z0-9_-]{20,})|[a-z0-9.-]{1,60}\.webhook\.office\.com/webhookb?2?/([A-Za-z0-9@/_-]{20,}))", "webhook"),
    Rule("url_userinfo", r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@\"'`<>{}$]{0,60}:((?!\$)[^\s/@\"'`<>{}]{3,})@[a-z0-9\[]", "password"),
    Rule("url_token", r"[a-z][a-z0-9+.-]{1,20}://([A-Za-z0-9_.~%+=-]{16,})@[a-z0-9\[]", "token"),
    Rule("dsn", r"(?<![\w/:])[\w.-]{1,40}:((?!\$)[^\s:/@\"'`{}<>]{4,})@(?:tcp|unix)\(", "password"),
    Rule("connection_string", r"(?:;|\"|'|\b)\s{0,3}(?:pwd|password)\s{0,3}=\s{0,3}((?!\$)[^;\s\"'`{}()<>]{4,})\s{0,3}[;\"']", "password"),
    Rule("account_key", r"\b(?:AccountKey|SharedAccessKey|SharedAccessSignature)\s{0,2}=\s{0,2}([A-Za-z0-9+/=%&_-]{16,})", "token"),
    Rule("basic", r"\bBasic\s{1,3}([A-Za-z0-9+/]{8,}={0,2})(?![A-Za-z0-9+/=])", "basic"),
    Rule("bearer", r"\bBearer\s{1,3}([A-Za-z0-9_.~+/=-]{16,})", "token"),
    Rule("authorization", r"""authorization["'`]?\]?\s{0,3}(?:=>|:|,|=)\s{0,3}["'`]?(?:(?:token|apikey|api-key|key|splunk|digest|sso-key)\s{1,2})?["'`]?([A-Za-z0-9_.~+/=-]{16,})""", "token"),
    Rule("named_string", _NAME + _TAIL + _SHUT + r"""\s{0,20}(?::=|=>|->|===?|!==?|=|:-|:|,|\|\||\?\?|\?:|\bor\b)\s{0,20}""" + _STR + r"""([^"'`\r\n]{3,})["'`]""", "either"),
    Rule("named_bare", _NAME + _TAIL + r"""["'`]?\]?\s{0,3}(?::-|:=|=>|[=:])\s{0,8}((?![$!@%&*|])""" + _BARE + r"""{6,})(?=$|[\s;,)}\]"'`&])""", "bare"),
    Rule("env_line", r"\b(?:ENV|ARG|setenv|requirepass|masterauth|ConvertTo-SecureString)\s{1,3}(?:[A-Z0-9_]{0,40}" + _NAME + r"\s{1,3})?[\"']?((?![$!@%&*|])" + _BARE + r"{6,})[\"']?(?=$|\s)", "strong"),
    Rule("env_key", r"(?<![a-z])(?:[a-z0-9]{1,30}_){1,4}key[\"']?\s{0,3}[=:]\s{0,3}[\"'`]?([^\s\"'`;,(){}<>\[\]$]{16,})", "token"),
    Rule("xml_value", _NAME + r"""["']\s{1,3}value\s{0,2}=\s{0,2}["']([^"'<>]{3,})["']""", "either"),
    Rule("xml_text", r"<(?:[\w.:-]{0,40})" + _NAME + r"(?:\s[^<>]{0,80})?>([^<>\s]{4,})</", "either"),
    Rule("query_parameter", r"[?&](?:access_token|api_?key|apikey|auth|token|secret|password|sig|key)=([^\s&\"'`<>{}$#)]{8,})", "either"),
    Rule("sql_password", r"(?:password|identified\s{1,3}by|pwd)\s{1,3}'([^'\r\n]{4,})'", "password"),
    Rule("login_call", r"""(?:log_?in|basic_?auth|auth|authenticate|authorize|connect|connection|logon|sign_?in|credentials?|client|session|database|mongo|smtp|ftp|ssh)\w{0,12}\(\s{0,3}(?:[^"'(),\r\n]{1,60},\s{0,2}){0,3}(?:""" + _QUOTED_WORD + r"""\s{0,2},\s{0,2}){1,3}["']([^"'\r\n]{4,})["']\s{0,2}[,)]""", "password"),
    Rule("auth_pair", r"""(?:auth|credentials?|creds|login)["']?\s{0,3}[=:]\s{0,3}[(\[]\s{0,2}""" + _QUOTED_WORD + r"""\s{0,2},\s{0,2}["']([^"'\r\n]{4,})["']\s{0,2}[)\]]""", "password"),
    Rule("token_call", r"""(?<!get)(?<!get_)(?:token|secret|api_?key|password|passwd|pwd)\w{0,12}\(\s{0,3}["']([^"'\r\n]{8,})["']\s{0,2}\)""", "either"),
    Rule("token_header", r"""["']?x-(?:(?:auth|api|access)(?:-?(?:token|key|secret))?|[a-z]{2,12}-?(?:token|key|secret|auth))["']?\s{0,3}(?::|,|=)\s{0,3}["']?([^"'\s\r\n]{12,})["']?""", "token"),
    Rule("remark", r"""["'`]([A-Za-z0-9+/=_.-]{16,})["'`][^"'`\r\n]{0,12}(?:\#|//|--|/\*)[^\r\n]{0,40}\b(?:token|secret|password|(?:api|access|socket|private)\s?key|\w{1,20} key)\b""", "token"),
    Rule("prose_slash", _ACCOUNT + r"\b[^\r\n/]{0,40}?[^\s/]{2,40} / [\"'`]?([^\s\"'`]{6,})", "strong"),
    Rule("prose_pair", _ACCOUNT + r"\b[^\r\n]{0,30}?\s(?:as|with|using|mit|als|con|como|avec)\s{1,2}[\"'`]?[\w.@-]{2,40}[\"'`]?\s{0,2}(?:,|:|/|\bwith\b|\band\b|\busing\b|\bund\b|\bmit\b|\by\b|\bcon\b|\bet\b)\s{0,2}(?:(?:the\s)?(?:password|pw|passwort|contraseña)\s)?[\"'`]?([^\s\"'`]{6,})", "strong"),
    Rule("prose_password", r"(?:password|passwort|kennwort|contraseña|passphrase|pwd)\b[^\r\n:=\"'`]{0,40}?(?::|\bis\b|\bist\b|\bes\b|\blautet\b)\s{1,3}[\"'`]?([^\s\"'`]{4,})", "password"),
    Rule("prose_after", r"(?:(?:password|passwort|kennwort|contraseña|passwd|pwd|passphrase|pass)s?[:=]?\s{1,3}|\bpw[ :=]\s{0,3})[\"'`]?([^\s\"'`=:,;(){}<>\[\]]{6,})", "strong"),
    Rule("prose_token", r"""[`"']([A-Za-z0-9+/=_.-]{16,})[`"'][^\r\n`"']{0,30}\b(?:api key|token|secret|access key|password)\b""", "token"),
    Rule("prose_token_after", r"""\b(?:api key|token|secret|access key)\b\s(?:is|ist|es|:|=)?\s?[`"']?([A-Za-z0-9+/=_.-]{16,})(?![\w(])""", "token"),
    Rule("command_user", r"(?: -u|--user|--userpwd)[\s=]{1,2}[\"']?[\w.@-]{1,40}:((?!\$)[^\s\"'`{}<>]{4,})", "password"),
    Rule("command_password", r"(?:--password|--passwd|--token|--secret|--api-?key|sshpass -p|\b(?:mysql\w{0,8}|mariadb\w{0,8}|docker login|mongo\w{0,8}|ldap\w{0,8}|redis-cli|htpasswd|smbclient|zip)\b[^\r\n]{0,80}\s-[pPaw])[\s=]{0,2}[\"']?([^\s\"'`{}$<>]{4,})", "either"),
]
#: Names whose value stands on the line below: a name with an operator and nothing after it, or the entry of a list of settings.
OPEN_NAME = Rule("open_name", _NAME + _TAIL + r"""["'`]?[\])]?\s{0,3}(?:(?::=|=>|=|:|\(|\|\|)\s{0,3}[\\(]?|["']?)\s{0,3}$""", "open")
NEXT_VALUE = re.compile(r"""^[+\- ]?\s*(?:["']?value["']?\s{0,2}[:=]\s{0,2})?[brfu]{0,2}["'`]([^"'`\r\n]{4,})["'`][\s,;)\\}]*$|^[+\- ]?\s*["']?value["']?\s{0,2}[:=]\s{0,2}((?![$!@%&*|])[^\s"'`;,(){}<>\[\]]{6,})\s*$""", re.IGNORECASE)
NEXT_QUOTED = re.compile(r"""^[+\- ]?\s*["']?value["']?\s{0,2}[:=]""", re.IGNORECASE)

# Words of which stand-ins are made, and passwords that come with a product or head every list.
_STAND_IN_WORDS = set("your my our the insert replace enter change put add some here me this it own with to in of a an is and or for from token tokens key keys secret secrets password passwords passwd passphrase pass pwd pw value values api access auth user username login name string text field example examples placeholder dummy sample redacted masked hidden removed todo fixme tbd lorem ipsum foo bar baz foobar test testing demo fake mock not real none null nil empty default changeme changeit xxx xxxx abc abcd client id private public prod dev local service account db database".split())
STOCK = set("changeme change_me change-me changeit password passw0rd p@ssw0rd p@ssword pa55word password1 password123 passwort admin admin123 administrator root toor guest user usuario username test test123 testing secret default postgres mysql oracle sa master letmein welcome welcome1 qwerty qwerty123 123456 12345678 123456789 1234 12345 111111 abc123 iloveyou monkey dragon minioadmin rabbitmq redis mongo mongodb elastic pass pass123 pwd token apikey none null empty string optional required hunter2 tomcat s3cret manager raspberry ubnt alpine vagrant docker calvin cisco password1! admin@123 p@ssw0rd1 changethis yourpassword mypassword supersecret foobared geheim contraseña contrasena".split())
_STOCK_CORE = set("password passwort admin root test user guest changeme pass example foo bar foobar demo sample dummy placeholder abc abcd qwerty letmein yourpassword mypassword".split())
_LEET = str.maketrans("4031$5@7", "aoeissat")
# Names of formats and services that hold digits and stand in identifiers.
_TECH = re.compile(r"(?<![a-z])(?:s3|ec2|utf\d+|x509|b64\w*|base64|u?int\d+|float\d+|sha\d+|md5|oauth2?|h26\d|v\d+|mp[34]|k8s|i18n|ipv[46]|http2|p12|pkcs\d+|[rhep]s\d{3}|aes\d+|ed25519|ssh2|\d{1,3})(?![a-z0-9])", re.IGNORECASE)
_SHAPE = re.compile(r"(?i)^(?:\*+|x{3,}|[.•_-]{3,}|0+|1234\w*|abcd?(?:efg?h?)?\d*|true|false|undefined|yes|no|on|off)$|^<.*>$|^\[.*\]$|^\{.*\}$|x{6,}|\*{3,}|\.{3,}|•{2,}|^ENC\(|^AES\(|^vault:|^secret(?:s|sm)?[:.]|^ssm:|^env[.:]|^arn:|^op://|^file:|^classpath:")
_PREFIXED_STAND_IN = re.compile(r"(?i)x{4,}|\*{3,}|\.{3,}|EXAMPLE|your[_-]?|placeholder|0{8,}|123456789|abcdefgh|replace|insert|redacted|dummy|fake")
UUID = re.compile(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
REFERENCE = re.compile(r"^(?:\$|%[A-Z_]+%|\{|<|@|&|!)|\$\{|\{\{|<[A-Za-z_ -]+>|\$\(|%\(|^%[sdv]$|\{\w*\}|^[A-Za-z_]+(?:\.[A-Za-z_]+|\[\w+\]|\(\)|::[A-Za-z_]+)+$|^/[\w/.-]+$|^\w+\(|\(\?[:=!]|\[\^|\\[wWsSdDb]|getenv|environ|process\.env|System\.env|Deno\.env|import\.meta")
NOT_SECRET_NAME = re.compile(r"(?i)(?:sha\d*|hash|hashed|digest|checksum|integrity|fingerprint|commit|revision|rev|uuid|public[_-]?key|primary[_-]?key|foreign[_-]?key|cache[_-]?key|sort[_-]?key|partition[_-]?key|key[_-]?id|pubkey|host[_-]?key)\W{0,4}$")
_NAME_TAIL = re.compile(_NAME + r"([\w.\]-]*)", re.IGNORECASE)
_OTHER_TAIL = re.compile(r"(?i)^[_.-]?(?:question|answer|policy|policies|field|label|hint|placeholder|length|len|min|max|hash|hashed|digest|salt|url|uri|path|file|filename|dir|folder|name|id|ids|type|format|regex|pattern|error|errors|message|msg|title|reset|prompt|header|endpoint|expir\w*|ttl|count|size|index|provider|strength|rules?|input|column|attribute|attr|param|env|var|variable|ref|source|arn|manager|store|service|encoder|kind|algorithm|issuer|audience|location|class|icon|page|form|view|screen|route|helper|test|schema|state|status|list|limit|version|scope|policy\w*)s?(?:[_.-]\w*)?$")
_UI_WORDS = set("please enter your you must should be at least characters invalid wrong incorrect required forgot forgotten reset confirm confirmation new old current password passwords passwort kennwort contraseña token secret key the a an of for to is are was not no with and or in on as by from this that user login sign account email missing empty expired mismatch match matches change changed update updated show hide hidden again repeat retype type choose set input field value bitte geben sie ihr vergessen ändern ungültig falsch introduzca su nueva olvidó".split())
DATA_URI = re.compile(r"data:[\w/+.-]+;base64,[^\"'`)\s]*$|(?:sha(?:1|256|384|512)[-:]|ssh-(?:rsa|ed25519|dss) |\bh1:)[A-Za-z0-9+/=]*$")
_FORMAT_WORD = re.compile(r"(?i)^(?:sha|md|aes|rsa|ed|utf|iso|rfc|base|oauth|http|h|x|v|rs|hs|es|ps|p|tls|ssl|py|python|node|java|cp|latin|win|argon|pbkdf|ripemd|blake|crc|ip|ipv|mp|log|web|es)[-_]?\d[\dxbits._-]*$")
_NOT_TYPED = re.compile(r"[\d.,:+/x-]+(?:px|em|rem|ms|s|kb|mb|gb|h|min|d|%)?|#[0-9a-fA-F]{3,8}|[\w.+-]+@[\w-]+\.[\w.-]+|\w+://\S*|\.{0,2}/[\w./-]*|[\w./-]+/[\w./-]+\.\w{1,5}|[\w-]+\.(?:js|ts|py|java|go|rb|php|json|ya?ml|xml|txt|md|html?|css|sh|sql|env|conf|cfg|ini|toml|pem|key|crt|p12|jks|png|jpg|svg|lock|log|com|org|net|io|dev)|[A-Z][A-Z0-9]*_[A-Z0-9_]*|v?\d+(?:\.\d+)+(?:[-+][\w.]+)?|\d{4}-\d\d-\d\d\S*|\d+(?:st|nd|rd|th)")


def entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def stand_in(v: str) -> bool:
    """Whether the whole value stands for another: a placeholder, a stock default, a mask, a reference."""
    low = v.lower()
    if low in STOCK or _SHAPE.search(v) or REFERENCE.search(v) or len(set(v)) < 4:
        return True
    if v.isalpha() and re.search(r"passwor[dt]|passwd|secret|token|apikey|changeme|placeholder|example|dummy", low):
        return True
    if low.translate(_LEET) in _STOCK_CORE:
        return True
    words = [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", v)]
    digits = sum(c.isdigit() for c in v)
    if words and digits <= 4 and all(w in _STAND_IN_WORDS for w in words):
        return True
    return bool(re.fullmatch(r"[^\w]?([a-z]+)[\W_]?\d{0,4}[!?.*#$@]{0,2}", low)) and re.sub(r"[^a-z]", "", low) in _STOCK_CORE


def is_token(v: str) -> bool:
    """A random string of some length."""
    if len(v) < 16 or re.search(r"\s", v) or stand_in(v) or UUID.match(v):
        return False
    core = re.sub(r"[^A-Za-z0-9]", "", v)
    if len(core) < 14 or len(core) < 0.75 * len(v):
        return False
    digits = sum(c.isdigit() for c in core)
    if digits == len(core) or "://" in v or entropy(v) < (2.6 if len(v) < 24 else 3.0):
        return False
    if digits:
        # Words joined to a name with a number at the end aren't random.
        return not re.fullmatch(r"[A-Za-z][a-z]*(?:[A-Z][a-z]*|[-_./][A-Za-z][a-z]*)*[-_./]?\d{0,3}|[A-Z]+(?:[-_.][A-Z]+)*[-_.]?\d{0,3}", v)
    # No digit at all: a word or path has few changes of case, random letters have many.
    flips = sum(a.isupper() != b.isupper() for a, b in zip(core, core[1:]))
    return flips >= 0.3 * len(core) and entropy(v) > 3.5


def is_identifier(v: str) -> bool:
    """Written as one writes a name in code: words in one consistent style, perhaps with one digit at the end."""
    v = v.strip("_")
    if v.isalpha() and sum(a.isupper() != b.isupper() for a, b in zip(v, v[1:])) <= len(v) / 3:
        return True
    return bool(re.fullmatch(r"[a-z]+(?:[ ._/:-]{1,2}[a-z]+)*\d?|[A-Z]+(?:[_-][A-Z]+)*\d?|[A-Z]?[a-z]+(?:[A-Z][a-z]+)*(?:[A-Z]{2,4})?\d?|[A-Z][a-z]+(?:[-_.][A-Z]?[a-z]+)+\d?", v))


def is_code_name(v: str) -> bool:
    """A name in code whose digits belong to formats and services, such as the last part of an assignment."""
    if not re.search(r"[_.]", v) or not re.search(r"\d", v):
        return False
    parts = [_TECH.sub("", p) for p in re.split(r"[_.]", v)]
    return all(not p or p.isalpha() and is_identifier(p) for p in parts) and any(not p for p in parts)


def _kinds(v: str) -> int:
    return sum(bool(re.search(p, v)) for p in (r"[a-z]", r"[A-Z]", r"\d", r"[^A-Za-z0-9]"))


def is_password(v: str, quoted: bool = True) -> bool:
    """A literal that a person would type as a password, rather than a word, a label or a reference."""
    if not 5 <= len(v) <= 200 or re.search(r"\s", v) or stand_in(v) or UUID.match(v):
        return False
    if _NOT_TYPED.fullmatch(v) or _FORMAT_WORD.match(v):
        return False
    bare = v.rstrip(".,;:!?)*#$")
    if is_identifier(bare) and (bare == v or v[-1] in ".,;:)") and not (quoted and re.search(r"\d", bare)):
        return False
    if re.fullmatch(r"[A-Za-z]+(?:-[A-Za-z]+)+", v) and not re.search(r"[a-z][A-Z]", v):
        return False
    if not re.search(r"\d", v):
        # Without a digit it must be long, or end as nobody ends a word.
        if bare.lower() in _UI_WORDS or len(v) < 8 or not quoted and is_identifier(bare):
            return False
    return _kinds(v) >= 2


def is_phrase(v: str) -> bool:
    """Several plain words or one long one, typed as a passphrase: none of those with which forms speak to their users."""
    words = v.split()
    if len(words) == 1:
        return bool(re.fullmatch(r"[a-z]{12,40}", v)) and not stand_in(v)
    return 4 <= len(words) <= 8 and all(re.fullmatch(r"[A-Za-z]{3,12}\d{0,3}", w) for w in words) and not any(w.lower() in _UI_WORDS for w in words)


def is_strong(v: str) -> bool:
    """A password by its look alone: what no word, name, number or path looks like."""
    if len(v) < 6 or not is_password(v, False) or _FORMAT_WORD.match(v) or re.search(r"[/\\|<>{}()\[\]=]", v):
        return False
    letters, digits = len(re.findall(r"[A-Za-z]", v)), len(re.findall(r"\d", v))
    if letters < 3:
        return False
    if digits:
        return len(v) >= 8 and (digits >= 2 or _kinds(v) >= 3) and not re.fullmatch(r"[A-Za-z]+[._-]\d+|\d+[A-Za-z]{1,3}", v)
    return len(v) >= 8 and bool(re.search(r"[_!#$%&*+?@^~]", v)) and bool(re.search(r"[a-z][A-Z]|[A-Z]{2}[a-z]|[A-Z][a-z][A-Z]", v)) and not re.fullmatch(r"[A-Z]?[a-z]+(?:[A-Z][a-z]+|[.'’-][A-Z]?[a-z]+)*[.'’-]?[.,;:!?]*|[A-Z]?[a-z]+(?:[A-Z][a-z]*)+s?[.,;:!?]*", v)


def judge(rule: Rule, value: str, before: str) -> bool:
    if rule.kind in ("key", "open"):
        return True
    if rule.kind == "webhook":
        return not _PREFIXED_STAND_IN.search(value)
    if rule.kind == "prefixed":
        # Hyphenated words in small letters may begin like a service key.
        random = rule.name != "service_key" or bool(re.search(r"\d", value) or re.search(r"[a-z]", value) and re.search(r"[A-Z]", value))
        return random and not _PREFIXED_STAND_IN.search(value) and len(set(value)) > 7
    if rule.kind == "basic":
        try:
            raw = base64.b64decode(value + "=" * (-len(value) % 4)).decode("utf-8")
        except ValueError:
            return False
        user, colon, secret = raw.partition(":")
        return bool(colon and user and raw.isprintable()) and not stand_in(secret) and len(secret) >= 4
    if DATA_URI.search(before):
        return False
    named = rule.name in ("named_string", "named_bare", "env_key", "xml_value", "open_name")
    phrase = False
    if named:
        if NOT_SECRET_NAME.search(before):
            return False
        if (m := _NAME_TAIL.match(before)) is not None:
            if _OTHER_TAIL.match(m.group(1)):
                return False
            phrase = rule.name == "named_string" and not m.group(1) and bool(re.match(r"(?i)pass|pwd|kennwort|contrase", before)) and not re.search(r",\s*\W?$", before)
    if rule.name in ("named_bare", "env_key", "prose_token_after", "prose_after", "env_line") and is_code_name(value):
        return False
    if rule.kind == "token":
        return is_token(value)
    if rule.kind == "strong":
        return is_strong(value) or len(value) >= 20 and is_token(value)
    if rule.kind == "bare":
        return is_token(value) or is_password(value, False) and (bool(re.search(r"\d", value)) or is_strong(value)) and not re.fullmatch(r"[A-Za-z_]+\d?(?:(?:\.|->|::)[A-Za-z_]+\d?)+", value)
    if rule.name in _ADDRESSED and re.fullmatch(r"[A-Za-z_-]{8,}", value) and not stand_in(value):
        return True  # whatever stands there is used as it is
    return (rule.kind == "either" and is_token(value)) or is_password(value) or phrase and is_phrase(value)


COMPILED = [re.compile(r.pattern, re.IGNORECASE) for r in RULES]
OPEN_COMPILED = re.compile(OPEN_NAME.pattern, re.IGNORECASE)
_JOINED = re.compile(r"""(["'])\s{0,4}(?:\+|\.\.|\.)\s{0,4}\1""")
_LISTED = re.compile(r"""["'`]\]?\s{0,20},\s{0,20}[brfu@]{0,2}["'`]$""", re.IGNORECASE)
_CALLED = re.compile(r"""\w\(\s{0,3}["'`][\w.-]*$""")
_ADDRESSED = {"url_userinfo", "dsn"}
_OVERLAPPING = {"named_string", "named_bare", "prose_after", "prose_slash", "prose_pair", "prose_password", "login_call"}
_TRIMMED = {"named_bare", "prose_slash", "prose_pair", "prose_password", "prose_after", "env_line"}


def joined(line: str) -> tuple[str, list[int]] | None:
    """A line whose literals are put together from pieces, as one, and the place of each character; None if there are none."""
    if not _JOINED.search(line):
        return None
    keep: list[int] = []
    at = 0
    for m in _JOINED.finditer(line):
        keep += range(at, m.start())
        at = m.end()
    keep += range(at, len(line))
    return "".join(line[i] for i in keep), keep


def spans_of(line: str, rules: list[int], follow: bool = True) -> list[tuple[int, int, str]]:
    """(start, end, rule) of the values on a line that the given rules find; overlapping ones are joined.

    ``follow``: also read the line with its pieced literals put together, by all rules.
    """
    found: list[tuple[int, int, str]] = []
    texts = [(line, None, rules)]
    if follow and (whole := joined(line)) is not None:
        texts.append((*whole, range(len(RULES))))
    for text, places, wanted in texts:
        for k in wanted:
            rule, p = RULES[k], 0
            while (m := COMPILED[k].search(text, p)) is not None:
                g = m.lastindex
                s, e = m.span(g)
                p = max(m.start() + 1, s + 1) if rule.name in _OVERLAPPING else max(m.end(), m.start() + 1)
                value = m.group(g)
                if rule.name in _TRIMMED:
                    trimmed = value.rstrip(",;.)")
                    e -= len(value) - len(trimmed)
                    value = trimmed
                if rule.name == "named_string" and _LISTED.search(text, m.start(), s) and not _CALLED.search(text[max(0, m.start() - 80) : m.start()]):
                    continue  # a name and its neighbour in a list, not a look-up with a default
                if value and judge(rule, value, text[max(0, m.start()) : s] if rule.kind != "key" else ""):
                    lo, hi = (s, e) if places is None else (places[s], places[e - 1] + 1)
                    if rule.kind == "key" or not DATA_URI.search(line[max(0, lo - 4000) : lo]):
                        found.append((lo, hi, rule.name))
                        p = max(p, e)
    out: list[tuple[int, int, str]] = []
    for s, e, r in sorted(found):
        if out and s < out[-1][1] and "private_key" not in (r, out[-1][2]):
            out[-1] = (out[-1][0], max(out[-1][1], e), out[-1][2])
        else:
            out.append((s, e, r))
    return out
