from src.app.services.user_service import UserService


def test_load():
    assert UserService().load(1)
