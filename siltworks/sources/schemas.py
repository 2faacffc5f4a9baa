"""Explicit schemas of the inputs; nothing is inferred on the way to a plan."""

REVIEWS = "user_id string, business_id string, stars double, date string, useful bigint"
BUSINESSES = "business_id string, city string, stars double, review_count bigint"
COMPLIMENTS = ("hot", "more", "profile", "cute", "list", "note", "plain", "cool", "funny", "writer", "photos")
USERS = ", ".join(
    ["user_id string", "review_count bigint", "average_stars double", "fans bigint", "useful bigint", "funny bigint", "cool bigint"]
    + [f"compliment_{c} bigint" for c in COMPLIMENTS]
    + ["friends string", "elite string"]
)
RATINGS = "user_id string, business_id string, stars double"
PAIRS = "user_id string, business_id string"
STREAM = "user_id string"
