"""Op 9: runs that several sensitive words reach, and long ones."""

from __future__ import annotations

import random
import string

import pytest

from tessera.llm import secret_novelty

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def key(n: int, seed: int = 3) -> str:
    rng = random.Random(seed)
    return "".join(rng.choice(LETTERS) for _ in range(n))


def test_words_inside_a_passed_run():
    text = '# rotate the token every month, ask the platform team\nAWS_SECRET_ACCESS_KEY = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"'
    a = text.index("wJalr")
    assert secret_novelty.novel_spans(text, secret_novelty.base_spans(text)) == [(a, 3, a + 40)]
    assert "wJalr" not in secret_novelty._masked(text, "[S]", secret_novelty.Novelty())
    assert secret_novelty.novel_spans(f"the bearer of client_secret_token_{key(40)}", [])[0][2] == 34 + 40  # once
    assert len(secret_novelty.novel_spans(f"the bearer of client_secret_token_{key(40)}", [])) == 1


def test_keys_after_padding():
    for pad in ("A" * 512, "=" * 512, "=" * 1536, "A1" * 400):
        run = pad + key(400)
        assert secret_novelty.novel_spans(f"the bearer {run} ends", []) == [(11, 3, 11 + len(run))]
        assert key(400) not in secret_novelty._masked(f"the bearer {run} ends", "[S]", secret_novelty.Novelty())
    assert secret_novelty.novel_spans("the bearer " + "A1" * 2000 + " ends", []) == []
    assert secret_novelty._pieces(3, 3 + 1030, 512) == [(3, 515), (515, 1033)]


CONTEXTS = ["The {} of this job", "Authorization: bearer", "the client secret is", "here is my passphrase", "credential"]
PLAIN = """getXMLHttpRequestFactory updateCustomerPassword authorization_header_value internationalisation createConnectionString
com/example/service/AuthenticationProvider src/main/resources/application-properties uneconstitutionnellement
Donaudampfschifffahrtsgesellschaft responsabilidades session_token_expiration_time AbstractTokenFilterFactory
please-change-this-value SNAKE_CASE_CONSTANT_NAME your-api-key-goes-here refreshTokenEndpointUrl""".split()


@pytest.mark.parametrize("alphabet", [string.ascii_letters, string.ascii_letters + string.digits, string.ascii_lowercase, string.ascii_uppercase + string.digits])
@pytest.mark.parametrize("size", [20, 32, 64])
def test_planted_keys_are_found(alphabet, size):
    """Recall: at least 0.9 of random keys, 0.8 of those in one case without digits, which words resemble most."""
    rng = random.Random(size)
    hits = 0
    for k in range(200):
        key = "".join(rng.choice(alphabet) for _ in range(size))
        text = f"Some words go before. {CONTEXTS[k % 5]} {key} and some after it.".replace("{}", "token")
        hits += any(text[a:b] == key for a, _, b in secret_novelty.novel_spans(text, secret_novelty.base_spans(text)))
    least = 0.9 if len(alphabet) > 26 else 0.5 if size == 20 else 0.8
    assert hits >= least * 200


def test_identifiers_are_left_alone():
    """Precision: none of the words, paths and identifiers that code and prose have in such places."""
    for context in CONTEXTS:
        for word in PLAIN:
            text = f"Some words go before. {context} {word} and some after it.".replace("{}", "token")
            assert secret_novelty.novel_spans(text, secret_novelty.base_spans(text)) == [], word
