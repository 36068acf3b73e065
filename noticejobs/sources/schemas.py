"""Canonical schemas; every reader uses them, nothing is inferred."""

NOTICE = (
    "id string, title string, description string, content string, category string, organization string, published_at timestamp, updated_at timestamp, "
    "deadline timestamp, priority string, views long, author string, status string, attachments array<string>, source_url string, source_portal string, "
    "is_ocr boolean, ai_summary string, key_facts array<string>, scraped_at timestamp, ocr_confidence int, tags array<string>"
)
USER = "id string, username string, email string, role string, created_at timestamp, last_login timestamp, status string"
ALERT_RULE = "id string, user_id string, type string, name string, conditions array<string>, enabled boolean, created_at timestamp, match_count long, last_matched_at timestamp"
ACTIVITY = "id string, user_id string, type string, description string, timestamp timestamp, related_id string"

#: Fixed values of the enums.
CATEGORIES = ("exams", "vacancies", "tenders", "policy", "announcements")
PRIORITIES = ("high", "normal", "low")
STATUSES = ("draft", "published", "archived")
CATEGORY_NAMES = {"gazette": "policy", "general": "announcements", "job": "vacancies", "exam": "exams", "tender": "tenders", "policy / administrative": "policy", "other": "announcements"}
