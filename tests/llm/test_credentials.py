"""Credentials in formats that were not read off the tables, and what must not be taken for one; redaction of keys."""

import random
import string

import pyarrow as pa
import pytest

from ledgerline.llm import credential_rules as CR
from ledgerline.llm.secrets import MASK, _hits, blank_out


def rand(n, seed, letters=string.ascii_letters + string.digits):
    r = random.Random(seed)
    return "".join(r.choice(letters) for _ in range(n))


T, H = rand(40, 1), rand(32, 2, "0123456789abcdef")
LIVE = [
    'password = "correct horse battery staple"',
    'String password = "correcthorsebattery";',
    'db_password: "Winterzeit!"',
    'secret_key = "mysamplepass9Q"',
    f'api_token = "example{rand(20, 3)}"',
    "export DB_PASSWORD=gr8tWall77 && run",
    "PGPASSWORD=gr8tWall77 psql -h db",
    f"docker run -e API_TOKEN={T} app",
    "ENV DB_PASSWORD gr8tWall77",
    'os.getenv("DB_PASSWORD", "gr8tWall77")',
    'os.environ.get("API_TOKEN") or "' + T + '"',
    "const pw = process.env.DB_PASSWORD || 'gr8tWall77';",
    'url: "${DB_PASSWORD:-gr8tWall77}"',
    f"Authorization: token {T}",
    f'"Authorization": "{T}"',
    "machine example.org login bob password gr8tWall77",
    'user.setPassword("gr8tWall77");',
    'db.connect("host.example", "bob", "gr8tWall77")',
    'requests.get(u, auth=("bob", "gr8tWall77"))',
    f"git clone https://{T}@forge.example/x.git",
    f"https://hooks.slack.com/services/T0{rand(8, 4).upper()}/B0{rand(8, 5).upper()}/{rand(24, 6)}",
    f"DefaultEndpointsProtocol=https;AccountName=x;AccountKey={rand(86, 7)}==;",
    f"bot = 731904628:AA{rand(33, 8)}",
    f"whsec_{rand(32, 9)}",
    f"hvs.{rand(24, 10)}",
    f"dapi{H}",
    f"key-{H}",
    "AGE-SECRET-KEY-1" + rand(58, 11, string.ascii_uppercase + string.digits),
    'curl -u "bob:gr8tWall77" https://x.example',
    "mysql -u root -pgr8tWall77 shop",
    "sshpass -p gr8tWall77 ssh bob@x.example",
    "redis-cli -h x -a gr8tWall77 ping",
    "redis://:gr8tWall77@cache:6379/0",
    "mongodb+srv://bob:gr8tWall77@c0.example.net/db",
    "jdbc:postgresql://db/x?user=bob&password=gr8tWall77",
    "Server=db;User Id=bob;Password=gr8tWall77;",
    "CREATE USER bob IDENTIFIED BY 'gr8tWall77';",
    "<password>gr8tWall77</password>",
    '<property name="db.password" value="gr8tWall77"/>',
    "//registry.example/:_authToken=" + T,
    f'{{"api_key": "{T}"}}',
    f'aws_session_token = "{rand(600, 12)}"',
    'token = "gh" + "p_' + rand(36, 13) + '"',
    'password: str = "gr8tWall77"',
    'var password string = "gr8tWall77"',
    "requirepass gr8tWall77",
    "Passwort lautet gr8tWall77",
    "# staging account bob / gr8tWall77",
    "connect as bob with gr8tWall77",
    "Zugang mit bob und gr8tWall77",
    f'client.headers["X-Api-Key"] = "{T}"',
    'if (password == "gr8tWall77") {',
    f"glpat-{rand(20, 14)}",
    f"xoxb-{rand(12, 15, string.digits)}-{rand(24, 16)}",
    f"?access_token={T}",
]
DEAD = [
    'password = os.environ["DB_PASSWORD"]',
    'password = getpass.getpass("Password for bob: ")',
    'password = "<your password>"',
    'password = "your-password-here"',
    'TOKEN = "xxxxxxxxxxxxxxxxxxxx"',
    'password = "********"',
    'password: ""',
    "DB_PASS=changeme",
    'api_key = "YOUR_API_KEY"',
    'token: "{{ vault_token }}"',
    "password: ${{ secrets.PASSWORD }}",
    'label: "Forgot your password?"',
    'placeholder="Enter a strong password"',
    "PASSWORD_MIN_LENGTH = 12",
    "password_hash CHAR(60) NOT NULL",
    'secretQuestion = "stage or tile?"',
    "passwordPolicy: strict",
    'token = tokens[75]  # next clock',
    "token := os.Getenv(\"API_TOKEN\")",
    'String token = request.getHeader("X-Auth");',
    f'"integrity": "sha512-{rand(86, 20)}=="',
    f'const rev = "{rand(40, 21, "0123456789abcdef")}"',
    'id: "0892aaec-065e-4bae-af5e-f9b9b870782a"',
    "postgres://postgres:postgres@localhost/db",
    'DATABASE_URL = f"postgresql://{user}:{password}@{host}/x"',
    "ssh-ed25519 AAAAC3NzaC1lZDI1NTE5AAAA" + rand(44, 22),
    "password=user_password,",
    "login(user, password)",
    "// rotate the password every 90 days",
    'if line.startswith("-----BEGIN RSA PRIVATE KEY-----"):',
    "the login page loads in 250 / 300ms on the host",
    "access as admin with sha256",
    "names = ['user_password', 'ACAccountStore7', 'x']",
    "host, access_key, secret_key = s3_example_simple",
    "password: _PasswordType | None = None,",
    "secret = utf8_deserializer.loads(infile)",
    "client.authenticate('test', 'p4ssw0rd')",
]


def test_long_values_take_linear_time():
    import time

    start = time.time()
    for v in ("a" * 60_000 + "1", "aB" * 30_000 + "1!", "a.b" * 20_000 + "_1", "A_" * 30_000 + "1x", "x" * 50_000):
        for f in (CR.is_token, CR.is_strong, CR.is_password, CR.is_identifier, CR.is_code_name, CR.stand_in):
            f(v)
    lines_found('+password = "' + "aBc-" * 20_000 + '1"\n+token: ' + "ab_" * 20_000 + "9\n")
    assert time.time() - start < 20


def lines_found(text):
    return {n for _, n, _ in _hits(pa.array([text]))}


@pytest.mark.parametrize("line", LIVE)
def test_live(line):
    assert lines_found(f"+{line}\n") == {1}, line


@pytest.mark.parametrize("line", DEAD)
def test_dead(line):
    assert lines_found(f" {line}\n x = 1\n") == set(), line


def test_value_on_the_next_line():
    assert lines_found('+password = \\\n+    "gr8tWall77"\n') == {2}
    assert lines_found("+- name: DB_PASSWORD\n+  value: gr8tWall77\n") == {2}
    assert lines_found("+- name: DB_PASSWORD\n+  value: changeme\n") == set()


def masked(text):
    hits = [(n, spans) for _, n, spans in _hits(pa.array([text]))]
    out, n = blank_out(text, hits)
    assert not lines_found(out), out
    return out, n


BODY = [rand(64, 30 + i, string.ascii_letters + string.digits + "+/") for i in range(3)]


def test_key_without_end_stops_at_code():
    code = "+const someVariableName = 1;\n+return someVariableName"
    out, n = masked("+-----BEGIN PRIVATE KEY-----\n+" + "\n+".join(BODY) + "\n" + code)
    assert out == "+-----BEGIN PRIVATE KEY-----\n" + f"+{MASK}\n" * 3 + code and n == 1


def test_password_before_a_marker():
    out, n = masked('+password = "gr8tWall77" -----BEGIN PRIVATE KEY-----\n+' + "\n+".join(BODY) + "\n+-----END PRIVATE KEY-----\n+x = 1")
    assert out == f'+password = "{MASK}" -----BEGIN PRIVATE KEY-----\n' + f"+{MASK}\n" * 3 + "+-----END PRIVATE KEY-----\n+x = 1" and n == 2


def test_one_line_key_with_escapes():
    out, n = masked('+{"key": "-----BEGIN PRIVATE KEY-----\\n' + "\\n".join(BODY) + '\\n-----END PRIVATE KEY-----\\n", "password": "gr8tWall77"}\n x')
    assert out == '+{"key": "-----BEGIN PRIVATE KEY-----\\n' + MASK + '\\n-----END PRIVATE KEY-----\\n", "password": "' + MASK + '"}\n x' and n == 2


def test_marker_with_a_remark():
    out, n = masked("+-----BEGIN PRIVATE KEY----- // see PRIVATE KEY docs\n+" + "\n+".join(BODY) + "\n+-----END PRIVATE KEY-----\n x")
    assert out == "+-----BEGIN PRIVATE KEY----- // see PRIVATE KEY docs\n" + f"+{MASK}\n" * 3 + "+-----END PRIVATE KEY-----\n x" and n == 1


def test_crlf_and_quoted_key_lines():
    out, n = masked("+// -----BEGIN EC PRIVATE KEY-----\r\n" + "".join(f'+// "{b}\\n" +\r\n' for b in BODY) + "+// -----END EC PRIVATE KEY-----\r\n x")
    assert out == "+// -----BEGIN EC PRIVATE KEY-----\r\n" + f'+// "{MASK}\\n" +\r\n' * 3 + "+// -----END EC PRIVATE KEY-----\r\n x" and n == 1
