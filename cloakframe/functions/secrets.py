"""Rules for credentials. They are this engine's own: vendor prefixes, labelled assignments behind an entropy check."""

from __future__ import annotations

from . import checks
from .rules import WB, WE, Rule

_secret = lambda v, *_: checks.secret(v)
_password = lambda v, *_: not checks.PLACEHOLDER.match(v)
ASSIGN = r"[\"']?\s*(?:=>|[:=])\s*[\"']?"
TOKEN = r"[A-Za-z0-9_\-./+=]{8,200}"


def _assigned(type_: str, id_: str, names: str, needs: tuple[str, ...], confidence: float = 0.85) -> Rule:
    return Rule(type_, id_, rf"(?<![A-Za-z0-9])(?:[a-z0-9]{{1,20}}[_-])?(?:{names}){ASSIGN}({TOKEN})", confidence, "i", 1, needs, _secret, source="secret")


SECRET_RULES: list[Rule] = [
    Rule("PRIVATE_KEY", "pem", r"-----BEGIN (?:[A-Z]{1,12} ){0,3}PRIVATE KEY-----[A-Za-z0-9+/=\s]{0,8000}(?:-----END (?:[A-Z]{1,12} ){0,3}PRIVATE KEY-----)?", 0.98, needs=("private key",), source="secret"),
    Rule("DATABASE_URL", "database-url", WB + r"(?:jdbc:)?(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|rediss?|amqps?|mssql|sqlserver)://[^\s\"'<>]{3,400}", 0.9, "i", needs=("://",), classify=lambda v: ("DATABASE_URL", 0.97 if "@" in v else 0.85), trim=r"[.,;:!?)\]}>'\"]+\Z", source="secret"),
    Rule("JWT", "jwt", r"(?<![A-Za-z0-9_\-])eyJ[A-Za-z0-9_\-]{5,2000}\.[A-Za-z0-9_\-]{5,4000}\.[A-Za-z0-9_\-]{5,1000}", 0.95, needs=("eyj",), validate=lambda v, *_: checks.jwt(v), source="secret"),
    Rule("AWS_ACCESS_KEY", "aws-access-key", WB + r"(?:AKIA|ASIA)[A-Z0-9]{16}" + WE, 0.95, needs=("akia", "asia"), source="secret"),
    Rule("GITHUB_TOKEN", "github-token", WB + r"(?:gh[pousr]_[A-Za-z0-9]{20,255}|github_pat_[A-Za-z0-9_]{20,255})", 0.97, needs=("gh", "github_pat_"), source="secret"),
    Rule("API_KEY", "vendor-key", WB + r"(?:sk-(?:ant-|proj-)?[A-Za-z0-9_\-]{16,200}|AIza[A-Za-z0-9_\-]{30,60}|[rs]k_(?:live|test)_[A-Za-z0-9]{10,200}|SG\.[A-Za-z0-9_\-]{10,80}\.[A-Za-z0-9_\-]{10,80}|npm_[A-Za-z0-9]{20,60}|hf_[A-Za-z0-9]{20,60}|glpat-[A-Za-z0-9_\-]{16,60})", 0.95, needs=("sk-", "aiza", "k_live_", "k_test_", "sg.", "npm_", "hf_", "glpat-"), source="secret"),
    Rule("ACCESS_TOKEN", "slack-token", WB + r"xox[abeoprs]-[A-Za-z0-9\-]{10,200}", 0.95, needs=("xox",), source="secret"),
    Rule("ACCESS_TOKEN", "bearer", WB + rf"bearer\s+({TOKEN})", 0.88, "i", 1, ("bearer",), _secret, source="secret"),
    _assigned("API_KEY", "api-key-assigned", "api[_-]?key|apikey|access[_-]?key(?:[_-]?id)?", ("key",)),
    _assigned("ACCESS_TOKEN", "token-assigned", "(?:access|auth|refresh|bearer|id)[_-]?token|token", ("token",)),
    _assigned("SECRET", "secret-assigned", "(?:client|signing|aws)[_-]?secret(?:[_-]?(?:access[_-]?)?key)?|secret[_-]?key|signing[_-]?key|private[_-]?key|secret", ("secret", "key")),
    Rule("PASSWORD", "password-assigned", rf"(?<![A-Za-z0-9])(?:password|passwd|pwd|passphrase|पासवर्ड){ASSIGN}([^\s\"',;<>]{{4,128}})", 0.88, "i", 1, ("password", "passwd", "pwd", "passphrase", "पासवर्ड"), _password, source="secret"),
    Rule("PASSWORD", "url-password", r"://[^\s:/@]{1,100}:([^\s:/@]{3,100})@", 0.85, "", 1, ("://",), _password, source="secret"),
]
