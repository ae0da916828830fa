"""Stand-ins for external services."""

import json
import math


def priced(ride_id):
    """The fare service: (status, body) for a request id as text."""
    number = float(ride_id or 0)
    if math.isnan(number) or number == 0:
        return 400, "no usable ride_request_id"
    part = math.fmod(math.e * number, 1.0)
    amount = math.floor(part * 91 + 10) * (1 + part * 0.4 - 0.2)
    return 200, json.dumps({"ride_request_id": number, "expected_fare": amount})
