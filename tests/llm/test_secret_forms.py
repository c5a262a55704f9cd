import random
import string

import pytest

from kindred.llm.secrets import scan_secrets

from .conftest import make_docs

B64 = string.ascii_letters + string.digits
LOW = string.ascii_lowercase + string.digits
FORMS = {
    "named": (lambda d: "sig=" + d(B64, 64), 4), "dashed": (lambda d: "key-" + d(LOW, 32), 4), "letters": (lambda d: d(string.ascii_letters, 48), 0),
    "uuid": (lambda d: "-".join(d("0123456789abcdef", n) for n in (8, 4, 4, 4, 12)), 0), "chat": (lambda d: f"xoxb-{d(string.digits, 12)}-{d(B64, 24)}", 18), "url": (lambda d: d(LOW + "-_", 48), 0),
}


@pytest.mark.parametrize("form", FORMS)
def test_random_tokens_of_other_forms(spark, form):
    rng = random.Random(9)
    make, at = FORMS[form]
    own = [make(lambda letters, n: "".join(rng.choice(letters) for _ in range(n))) for _ in range(120)]
    got = {r.doc_id: r.random for r in scan_secrets(make_docs(spark, [(i, f"see {t} there") for i, t in enumerate(own)])).collect()}
    hit = [i for i, t in enumerate(own) if any((s.start, s.end) in ((4 + at, 4 + len(t)), (4, 4 + len(t))) for s in got[i])]
    assert len(hit) >= 80


def test_long_names_stay_out(spark):
    names = ["some-very-long-option-name-of-a-tool", "path/to/the/installation/directory", "ThisIsALongClassNameWithManyWords", "internationalizationservice"]
    got = scan_secrets(make_docs(spark, [(i, names[i % 4]) for i in range(200)])).collect()
    assert sum(bool(r.random) for r in got) <= 5
