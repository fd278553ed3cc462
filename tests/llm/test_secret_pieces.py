"""Random tokens glued to a key, a path or other words by characters of no common alphabet."""

from __future__ import annotations

import random

import pytest
from corvane.llm import secrets

BASE62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


@pytest.mark.parametrize("shape", ["sig={}", "access_key={}", "a=1&sig={}&x=2", "/v1/my-app/{}", "my_app+v2/{}/get-it", "x=/v1/my-app/{}"])
def test_glued(shape):
    rng = random.Random(5)
    found = 0
    for _ in range(100):
        token = "".join(rng.choices(BASE62, k=40))
        text = f"see {shape.format(token)} here"
        hits = [(a, b) for a, k, b, _ in secrets.spans_of(text) if k == 3]
        assert len(hits) <= 1
        found += any(a <= text.index(token) and b >= text.index(token) + 40 for a, b in hits)
        assert not hits or token not in secrets.blanked(text)
    assert found > 85


def test_base64_after_a_path():
    rng = random.Random(6)
    drawn = ["".join(rng.choices(BASE62 + "+/", k=44)) for _ in range(100)]
    assert sum(t not in secrets.blanked(f"at my-app/{t}== now") for t in drawn) > 85


def test_glued_words_stay():
    for text in ("name=get_user_profile_by_identifier", "/srv/my-app/internationalizationframework/the_quick_brown_fox", "a=b=the_quick_brown_fox_jumps_over=c", "=" * 40, "-/" * 30):
        assert secrets.spans_of(text) == []
