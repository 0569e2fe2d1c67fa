"""Operators for preparing training corpora: each module holds one, with its query; nothing else imports them."""
