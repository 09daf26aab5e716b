"""The reference has no streams: time enters as daily batches, so there is nothing to build here."""
