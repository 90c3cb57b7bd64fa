from fastapi import APIRouter, Depends
from src.app.services.user_service import UserService

router = APIRouter()


@router.get("/me", summary="Me")
async def me(user=Depends(get_current_user)):
    """Return the user."""
    return UserService().load(1)


@router.post("/")
def create(name: str, age: int = 3, *rest, flag=False, **more) -> dict:
    return UserService().save(name)


@router.websocket("/ws")
async def feed(ws):
    pass
