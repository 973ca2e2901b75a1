"""Texts and numbers that results must carry exactly."""

# Labels shown when a field is missing.
UNKNOWN = "Unknown"
UNKNOWN_KEY = "unknown"
OWN_LABEL = "Me"
OUTGOING = "outgoing"
INCOMING = "incoming"
NO_SUBJECT = "No Subject"
NO_CONTENT = "No content"
UNTITLED = "Untitled"
UNTITLED_EVENT = "Untitled Event"
UNTITLED_REMINDER = "Untitled Reminder"
DEFAULT_CALENDAR = "Calendar"
DEFAULT_REMINDER_LIST = "Reminders"
DEFAULT_DUE = "Today"
DEFAULT_START = "TBD"
UNKNOWN_DATE = "Unknown date"
DEFAULT_MODEL = "Default"
EMPTY_TRANSCRIPT = "No messages found."

# Digest texts of empty sources.
NO_EMAILS = "No new emails in the last 24 hours."
NO_EVENTS = "No calendar events for today."
NO_REMINDERS = "No reminders due today."
NO_MESSAGES = "No new messages in the last 24 hours."

# Windows, caps and budgets.
SECONDS_1970_TO_2001 = 978307200
NANOS_THRESHOLD = 100000000000
NANOS_PER_SECOND = 1000000000
DIGEST_EMAIL_FETCH, DIGEST_EMAIL_SHOW, DIGEST_EMAIL_CHARS = 15, 10, 2000
DIGEST_EVENT_FETCH, DIGEST_EVENT_SHOW = 10, 8
DIGEST_REMINDER_FETCH, DIGEST_REMINDER_SHOW = 10, 8
DIGEST_MESSAGE_FETCH, DIGEST_THREADS, DIGEST_MESSAGE_CHARS = 200, 5, 1500
EMAIL_LINE_BODY = 200
PREVIEW_MESSAGES, PREVIEW_PIECE, PREVIEW_TOTAL = 3, 50, 150
MEDIUM_TOKENS, LARGE_TOKENS = 10000, 20000
TOKEN_CAP, TOKEN_FLOOR, CHAT_TOKENS = 2048, 128, 160
CHUNK_CHARS = 120
CONTEXT_TURNS = 4
ANSWER_SENTENCES = 4
SUMMARY_LIST_ROWS = 100
FIND_EMAIL_HOURS, FIND_EMAIL_ROWS = 48, 50
EXPORT_SUBJECT_CHARS = 50
RULER = "=" * 50

# Request errors.
ERROR_NO_BODY = "No email body provided"
ERROR_ITEM = "kind and content are required"
ERROR_KIND = "Unknown kind: "
ERROR_EMAIL_QUESTION = "Question and email body are required"
ERROR_ITEM_QUESTION = "kind, context, and question are required"
ERROR_SUMMARY = "Failed to generate summary"
ERROR_ANSWER = "Failed to generate response"
ALL_MODELS_FAILED = "All models failed"

# System prompts.
EMAIL_SYSTEM = "You are a helpful assistant that summarizes emails concisely."
ITEM_SYSTEM = {
    "calendar": (
        "You are a helpful assistant that summarizes upcoming calendar events. "
        "Do not include code blocks or templates."
    ),
    "reminder": (
        "You are a helpful assistant that summarizes reminders and action items. "
        "Do not include code blocks or templates."
    ),
    "messages": (
        "You are a helpful assistant that summarizes message conversations. "
        "Do not include code blocks or templates."
    ),
}
EMAIL_QUESTION_SYSTEM = (
    "You are a helpful assistant answering questions about an email. "
    "Use the provided email content and summary to answer questions accurately and concisely. "
    "Do not repeat the question or include labels."
)
ITEM_QUESTION_SYSTEM = (
    "You are a helpful assistant answering questions based on the provided context. "
    "Use the context accurately and respond concisely. "
    "Do not repeat the question or include labels."
)
DIGEST_SYSTEM = (
    "You are a personal assistant creating a daily briefing. "
    "Synthesize the information into a clear, actionable digest. "
    "Be concise but comprehensive. Use bullet points and clear sections. "
    "Focus on what matters most and any action items."
)

# User prompts; {…} marks where a field goes.
EMAIL_PROMPT = (
    "Summarize this email concisely. Include key points, actions needed, and important details."
    "\n\nEmail:\n{body}\n\nSummary:"
)
ITEM_PROMPT = {
    "calendar": (
        "Summarize this calendar item. Focus on time, location, and preparation needed."
        "\n\nTitle: {title}\n{content}\n\nSummary:"
    ),
    "reminder": (
        "Summarize this reminder and suggest any action needed."
        "\n\nTitle: {title}\n{content}\n\nSummary:"
    ),
    "messages": (
        "Summarize today's messages in this conversation. Highlight decisions and next steps."
        "\n\nConversation: {title}\n{content}\n\nSummary:"
    ),
}
QUESTION_PROMPT = (
    "Context:\n{context}\n\nQuestion: {question}\n\nRespond with a concise answer."
)
CONTEXT_HEADING = {
    "calendar": "Calendar context:",
    "reminder": "Reminder context:",
    "messages": "Messages context:",
}
CONTEXT_HEADING_DEFAULT = "Context:"
DIGEST_PROMPT = """Create my daily digest for today based on this data:

## EMAILS ({n_emails} total)
{emails}

## CALENDAR ({n_events} events)
{events}

## REMINDERS ({n_reminders} items)
{reminders}

## MESSAGES ({n_threads} conversations)
{messages}

---

Please create a structured daily digest with these sections:
1. **Today's Schedule** - Key events and their times
2. **Priority Actions** - What needs attention today (from emails, reminders, messages)
3. **Email Highlights** - Important messages that need response or attention
4. **Message Summary** - Key conversations and any follow-ups needed
5. **Quick Notes** - Anything else noteworthy

Keep each section concise. If a category has no items, briefly note it's clear."""

# White space as str.strip() sees it, and the breaks str.splitlines() knows.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
OTHER_BREAKS = "[\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"
RULER_MARKS = "`-_~"

# Labels a model may put in front of its answer.
ANSWER_LABELS = ("assistant", "final answer", "your response", "response", "answer")

# Headings of the reports.
REPORT_HEAD = "=== EMAIL EXPORT ===\n\nDate: "
REPORT_MAIL = "\n\n--- ORIGINAL EMAIL ---\n\n"
REPORT_SUMMARY = "\n\n--- AI SUMMARY ---\n\n"
REPORT_CHAT = "\n\n--- CHAT CONVERSATION ---\n"
REPORT_FOOT = "=== END OF EXPORT ===\nExported on: "
DIGEST_HEAD = "=== DAILY DIGEST ===\nGenerated: "
DIGEST_FOOT = "\n=== END OF DIGEST ===\n"

# Headings of what a question about a mail is asked with.
CONTEXT_MAIL = "Email Content:\n{body}\n\n"
CONTEXT_SUMMARY = "Summary:\n{summary}\n\n"
CONTEXT_TALK = "Previous conversation:\n{turns}\n\n"

# Progress frames of a digest.
DIGEST_PHASES = (
    ("gathering", "Gathering your data..."),
    ("analyzing", "Analyzing content..."),
    ("generating", "Generating your digest..."),
)

# What a field of a mail record looks like in an export.
MAIL_FIELD = r'"{name}":"([^"]*)"'
MAIL_BODY = r'(?s)"body":"(.*?)"(?:,|\})'
