import requests


class UserService:
    """Users."""

    def load(self, key):
        # TODO: cache this
        return requests.get("https://api.example.com/users")

    def save(self, name):
        return self.load(name)


def twice(x):
    y = x * 2
    return y


def double(x):
    y = x * 2
    return y
