"""A log that has the published cardinalities, built from them.

Roles are dealt out in cohort order: first to the users active in week 1, then to the
others. Ids of cart users are chosen so that the md5 split gives the published variants.
"""

from __future__ import annotations

import hashlib
from datetime import datetime, timedelta
from itertools import count

import published as pub


def _ids():
    """Endless ids by variant."""
    queues = {"A_control": [], "B_treatment": []}
    numbers = count(1)

    def take(variant: str) -> str:
        while not queues[variant]:
            user = f"U{next(numbers):06d}"
            odd = hashlib.md5(user.encode()).digest()[-1] & 1
            queues["B_treatment" if odd else "A_control"].append(user)
        return queues[variant].pop()

    return take


def _deal(table: dict, bought: bool) -> list[str]:
    return [
        value
        for value, (users, purchased, *_) in table.items()
        for _ in range(purchased if bought else users - purchased)
    ]


def build():
    """Rows of events, users and products."""
    slots = [
        (month, place < active)
        for month, (users, active, *_) in pub.COHORTS.items()
        for place in range(users)
    ]
    cart_left = {
        active: {v: (row[4] if active else row[0] - row[4]) for v, row in pub.VARIANTS.items()}
        for active in (True, False)
    }
    successes_left = {variant: row[1] for variant, row in pub.VARIANTS.items()}
    late_left = pub.CART_AND_PURCHASE - sum(successes_left.values())
    no_cart_purchases_left = pub.PURCHASE_WITHOUT_CART
    viewless_left = pub.VIEWLESS
    genders = {b: iter(_deal(pub.GENDERS, b)) for b in (True, False)}
    categories = {b: iter(_deal(pub.CATEGORIES, b)) for b in (True, False)}
    take = _ids()

    events, users = [], []
    for month, active in slots:
        start = datetime.strptime(month, "%Y-%m") + timedelta(days=3, hours=5)
        variant = next((v for v, n in cart_left[active].items() if n), None)
        user = take(variant or "A_control")

        def log(kind, when, product=None, user=user):
            events.append((user, product, kind, when))

        bought = False
        if variant:
            cart_left[active][variant] -= 1
            cart_ts = start + timedelta(hours=1)
            if successes_left[variant]:
                successes_left[variant] -= 1
                bought = True
                log("purchase", cart_ts + timedelta(days=1))
            elif late_left:
                late_left -= 1
                bought = True
                log("purchase", start + timedelta(days=60))
            log("cart", cart_ts, f"P-{next(categories[bought])}")
            gender = next(genders[bought])
            log("view", start)
        else:
            gender = "Other"
            if viewless_left:
                viewless_left -= 1
                log("wishlist", start)
            else:
                log("view", start)
            if no_cart_purchases_left:
                no_cart_purchases_left -= 1
                log("purchase", start + timedelta(days=60))
        if active:
            log("wishlist", start + timedelta(days=8))
        users.append((user, gender))
    products = [(f"P-{category}", category) for category in pub.CATEGORIES]
    return events, users, products
