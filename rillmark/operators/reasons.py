"""Texts that a rejected event is given."""

from __future__ import annotations

# Reasons that clients see and match.
NOT_OBJECT = "an event must be a JSON object"
NO_MESSAGE_ID = "messageId is required: printable ASCII without spaces, at most 128 characters, generated once per event and reused on retry"
NO_EVENT = "event is required: a name starting with a letter, using letters, digits and _ . : -, at most 128 characters"
NO_IDENTITY = "userId or anonymousId is required"
BAD_IDENTITY = "userId and anonymousId are limited to 256 characters without control characters"
NO_TIMESTAMP = "timestamp is required: ISO 8601 with a UTC offset or Z, for example 2026-09-23T10:15:00.000Z"
BAD_VERSION = "version, when present, must be an integer between 1 and 65535"
IN_FUTURE = "timestamp is more than 5 minutes ahead of the collector clock"
TOO_OLD = "timestamp is older than the 90 day retention period"
NOT_PROPERTIES = "properties must be a JSON object"
MUST_BE = {"string": "a string", "number": "a finite number", "integer": "an integer", "boolean": "a boolean"}
TOO_LARGE = " (payload not kept: larger than 64 KiB)"
